"""Money is integer cents everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.parsing import _c


def parse_cents(text: Column | str) -> Column:
    """`$1,234.56` to cents; null for anything that is not an amount with at most two decimals."""

    amount = F.regexp_extract(F.regexp_replace(_c(text), r"[$,\s]", ""), r"^[+-]?\d+(\.\d{1,2})?$", 0)
    # An amount beyond the range of a long is none.
    return (F.nullif(amount, F.lit("")).try_cast("decimal(21,2)") * 100).try_cast("long")


def format_cents(cents: Column | str) -> Column:
    """Cents to `-$1,234.56`."""

    c = _c(cents).cast("long")
    size = F.abs(c)
    whole = F.format_number(F.floor(size / 100).cast("long"), 0)
    return F.concat(
        F.when(c < 0, "-").otherwise(""), F.lit("$"), whole, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0")
    )


def _one_decimal(value: Column, unit: float, suffix: str) -> Column:
    tenths = F.floor(value / (unit / 10) + 0.5).cast("long")
    return F.concat(
        F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(suffix)
    )


def _whole(value: Column, unit: float, suffix: str) -> Column:
    return F.concat(F.floor(value / unit + 0.5).cast("long").cast("string"), F.lit(suffix))


def fmt_compact(value: Column | str) -> Column:
    """`1.2M`, `45k`, `310`; an em dash for null."""
    v = _c(value).cast("double")
    return (
        F.when(v.isNull(), "—")
        .when(v >= 1e7, _whole(v, 1e6, "M"))
        .when(v >= 1e6, _one_decimal(v, 1e6, "M"))
        .when(v >= 1e4, _whole(v, 1e3, "k"))
        .when(v >= 1e3, _one_decimal(v, 1e3, "k"))
        .otherwise(_whole(v, 1.0, ""))
    )


def fmt_usd(value: Column | str) -> Column:
    """Compact dollars; `$0` for zero or less, an em dash for null or non-finite."""
    v = _c(value).cast("double")
    endless = F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        F.when(v.isNull() | endless, "—")
        .when(v <= 0, "$0")
        .otherwise(F.concat(F.lit("$"), fmt_compact(v)))
    )
