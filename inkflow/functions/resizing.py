"""The target size of a picture, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ratio that stands for "fit to WIDTH", and what is too small to be worth a resampled copy.
FIT, WIDTH, LEAST_WIDTH, LEAST_HEIGHT = 70, 1280, 500, 100


def plan(width: Column, height: Column, ratio: int) -> dict[str, Column]:
    """target_w, target_h, do_resize, warn_small.

    100: nothing changes. 70: width 1280, smaller pictures as they are. Others: that part of the size,
    halves rounded away from zero. A result of at most 500 by anything, or anything by at most
    100, warns and isn't resampled.
    """
    width, height = width.cast("long"), height.cast("long")
    if ratio == 100:
        return {"target_w": width, "target_h": height, "do_resize": F.lit(False), "warn_small": F.lit(False)}
    factor = F.lit(float(WIDTH)) / width.cast("double") if ratio == FIT else F.lit(ratio / 100)
    small = F.lit(ratio == FIT) & (width <= WIDTH)
    w, h = (F.when(small, x).otherwise(F.round(x.cast("double") * factor).cast("long")) for x in (width, height))
    warn = (w <= LEAST_WIDTH) | (h <= LEAST_HEIGHT)
    return {"target_w": w, "target_h": h, "do_resize": ~small & ~warn, "warn_small": warn}
