"""Option texts as columns; what the settings refuse is null here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkflow.config import CHARSET_NAMES, CHARSETS, DCT_METHODS, KERNELS


def _dictionary(known: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


def percent(text: Column, default: int) -> Column:
    n = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))
    return F.when(n >= 100, 100).when(n <= 0, default).otherwise(n).cast("int")


def charsets(text: Column) -> Column:
    """Encodings in order, a spelling once; null for an empty list or one with an unknown token."""
    found = F.transform(F.array_distinct(F.split(F.lower(text), ",")), lambda t: F.try_element_at(_dictionary(CHARSETS), t))
    return F.when((text != "") & ~F.exists(found, lambda e: e.isNull()), found)


def charset_names(encodings: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(encodings, lambda e: F.try_element_at(_dictionary(CHARSET_NAMES), e))), ",")


def dct_method(text: Column) -> Column:
    return F.when(text.isin(*DCT_METHODS), text)


def kernel(text: Column) -> Column:
    return F.when(text.isin(*KERNELS), text)
