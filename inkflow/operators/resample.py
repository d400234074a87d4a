"""Separable resampling: kernels, their weights, and both as numpy and as columns."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkflow.config import KERNELS, one_of


def _cubic(b: float, c: float):
    """The two-parameter family of cubic filters."""

    def value(x: float) -> float:
        x = abs(x)
        if x < 1:
            return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
        if x < 2:
            return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6
        return 0.0

    return value


def _lanczos(a: int):
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    return lambda x: sinc(x) * sinc(x / a) if abs(x) < a else 0.0


#: Half widths and shapes.
SHAPES = {
    "nearest-neighbor": (0.5, lambda x: 1.0 if -0.5 <= x < 0.5 else 0.0),
    "bilinear": (1.0, lambda x: max(0.0, 1 - abs(x))),
    "bicubic": (2.0, _cubic(0, 0.5)),
    "mitchell-netravali": (2.0, _cubic(1 / 3, 1 / 3)),
    "lanczos2": (2.0, _lanczos(2)),
    "lanczos3": (3.0, _lanczos(3)),
}


@lru_cache(maxsize=256)
def weights(size: int, target: int, kernel: str) -> tuple[tuple[tuple[int, float], ...], ...]:
    """For each target sample: (source sample, weight), weights adding up to 1.

    A smaller target stretches the kernel by the factor, so every source sample counts; samples
    beyond an edge are the edge's.
    """
    one_of(kernel, KERNELS, "interpolation")
    factor = size / target
    if kernel == "nearest-neighbor":
        return tuple(((min(size - 1, int((i + 0.5) * factor)), 1.0),) for i in range(target))
    support, shape = SHAPES[kernel]
    stretch = max(1.0, factor)
    rows = []
    for i in range(target):
        middle = (i + 0.5) * factor - 0.5
        found: dict[int, float] = {}
        for j in range(math.floor(middle - support * stretch), math.ceil(middle + support * stretch) + 1):
            if w := shape((j - middle) / stretch):
                at = min(size - 1, max(0, j))
                found[at] = found.get(at, 0.0) + w
        total = sum(found.values())
        rows.append(tuple((at, w / total) for at, w in sorted(found.items())))
    return tuple(rows)


@lru_cache(maxsize=64)
def _matrix(size: int, target: int, kernel: str) -> np.ndarray:
    found = np.zeros((target, size), dtype=np.float32)
    for i, row in enumerate(weights(size, target, kernel)):
        for at, w in row:
            found[i, at] = w
    return found


def resample(image: np.ndarray, width: int, height: int, kernel: str) -> np.ndarray:
    """A picture of bytes (rows, columns, channels) in another size."""
    rows, columns, channels = image.shape
    if (columns, rows) == (width, height):
        return image
    down = _matrix(rows, height, kernel) @ image.reshape(rows, -1).astype(np.float32)
    across = np.einsum("wx,hxc->hwc", _matrix(columns, width, kernel), down.reshape(height, columns, channels), optimize=True)
    return np.clip(np.rint(across), 0, 255).astype(np.uint8)


def resampled_line(samples: Column, size: int, target: int, kernel: str) -> Column:
    """An array of `size` numbers as one of `target`, in built-in functions only."""
    rows = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), F.lit(w).alias("w")) for at, w in row]) for row in weights(size, target, kernel)])
    return F.transform(rows, lambda row: F.aggregate(row, F.lit(0.0), lambda total, x: total + F.get(samples, x["at"]).cast("double") * x["w"]))
