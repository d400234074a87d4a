"""Columns about member names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of pictures, and what converted ones end in.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
TARGET = ".jpg"


def extension(path: Column) -> Column:
    """From the last dot of the last part of the lower-cased path; empty without a dot."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)\z", 1)


def is_picture(path: Column, extensions: Iterable[str] = EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def outside_git(path: Column) -> Column:
    """Not below the .git at the root; deeper ones count as other folders do."""
    return ~path.startswith(".git/")


def walk_key(path: Column) -> Column:
    """Orders members as a walk does: depth first, by name within each folder."""
    return F.split(path, "/")


def renamed(path: Column, ext: Column, target: str = TARGET) -> Column:
    """path with target for ext, which is taken off only where the path ends in just that."""
    return F.concat(F.when(path.endswith(ext), F.substring(path, F.lit(1), F.char_length(path) - F.char_length(ext))).otherwise(path), F.lit(target))


def with_zip(path: Column) -> Column:
    return F.when(path.endswith(".zip"), path).otherwise(F.concat(path, F.lit(".zip")))


def default_output(path: Column) -> Column:
    """<stem>_resize<ext>, the dot being looked for in the last part of the path, then .zip if need be."""
    return with_zip(F.regexp_replace(path, r"^((?:.*/)?[^/]*?)(\.[^./]*)?\z", "$1_resize$2"))


def plugin_name(name: Column) -> Column:
    return F.ltrim(F.lower(name), F.lit("."))


def info(engine: Column, width: Column, height: Column) -> Column:
    return F.format_string("{engine:%s, w:%d, h:%d}", engine, width, height)


def failure(what: Column, path: Column, cause: Column) -> Column:
    return F.concat(what, F.lit(": "), path, F.lit(" error, "), cause)
