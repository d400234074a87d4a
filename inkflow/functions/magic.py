"""Formats by their first bytes, and sizes from headers, as columns."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first bytes of the formats; ? stands for any byte.
JPEG, PNG, BMP, WEBP = b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"BM????\x00\x00\x00\x00", b"RIFF????WEBPVP8"


def matches(content: Column, pattern: bytes) -> Column:
    """Whether content begins with pattern; one that is shorter does not."""
    found = F.octet_length(content) >= len(pattern)
    for wild, part in groupby(enumerate(pattern), key=lambda x: x[1] == ord("?")):
        if not wild:
            places, values = zip(*part, strict=True)
            found = found & (F.substring(content, places[0] + 1, len(values)) == F.lit(bytes(values)))
    return found


def engine(content: Column, patterns: dict[str, bytes]) -> Column:
    """The first format whose pattern matches, or null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        found = F.when(matches(content, pattern), name).otherwise(found)
    return found


def number(content: Column, at: int, size: int, big: bool = True) -> Column:
    """The unsigned number of `size` bytes that begins at byte `at`, counted from 0."""
    digits = [F.substring(content, at + 1 + i, 1) for i in (range(size) if big else reversed(range(size)))]
    return F.conv(F.hex(F.concat(*digits)), 16, 10).cast("long")


def png_size(content: Column) -> Column:
    return F.when(F.octet_length(content) >= 24, F.struct(number(content, 16, 4).cast("int").alias("width"), number(content, 20, 4).cast("int").alias("height")))


def bmp_size(content: Column) -> Column:
    """A negative height, which stands for rows from the top, counts as its amount."""
    signed = lambda at: (number(content, at, 4, big=False) + 2**31) % 2**32 - 2**31
    return F.when(F.octet_length(content) >= 26, F.struct(signed(18).cast("int").alias("width"), F.abs(signed(22)).cast("int").alias("height")))


def webp_size(content: Column) -> Column:
    """From a lossy, a lossless or an extended header; null where none of them is whole."""
    kind, size = F.substring(content, 13, 4), F.octet_length(content)
    little = lambda at, n: number(content, at, n, big=False)
    pair = lambda width, height: F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    lossy = F.when((size >= 30) & (F.substring(content, 24, 3) == F.lit(b"\x9d\x01\x2a")), pair(little(26, 2) % 2**14, little(28, 2) % 2**14))
    bits = little(21, 4)
    lossless = F.when((size >= 25) & (F.substring(content, 21, 1) == F.lit(b"\x2f")), pair(bits % 2**14 + 1, F.floor(bits / 2**14) % 2**14 + 1))
    extended = F.when(size >= 30, pair(little(24, 3) + 1, little(27, 3) + 1))
    return F.when(kind == F.lit(b"VP8 "), lossy).when(kind == F.lit(b"VP8L"), lossless).when(kind == F.lit(b"VP8X"), extended)
