"""Number helpers that follow the corpus conventions: missing is never zero, NaN and infinity are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.when(b != 0, a / b)


def hash01(text: Column) -> Column:
    """A text's place in [0, 1]: the first eight hex digits of its SHA-1 over 2**32 - 1."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def half_even(x: Column) -> Column:
    return F.rint(x)


def quantize_probability(p: Column) -> Column:
    """0..255, floor(255 p + 0.5) in doubles."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(p.cast("double") * 255 + 0.5)))


def threshold_level(t: Column) -> Column:
    """The least quantised value that passes threshold t."""
    return F.greatest(F.lit(1), F.least(F.lit(255), F.floor(t.cast("double") * 255 + 1)))


def realised_threshold(level: Column) -> Column:
    return (level - 0.5) / 255.0
