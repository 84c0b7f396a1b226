"""Rounding by the exact binary value of a double, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2^27 + 1 cuts a double into two halves whose products with small integers are exact


def round_half_even(x: Column, digits: int) -> Column:
    """Nearest decimal to the double itself, as scripting languages round; built-ins round its decimal text."""
    scale = float(10**digits)
    low = F.floor(x * scale).cast("double")
    high_half = x * SPLIT - (x * SPLIT - x)
    over = (high_half * (2 * scale) - (low * 2.0 + 1.0)) + (x - high_half) * (2 * scale)
    up = (over > 0) | ((over == 0) & (low % 2 != 0))
    return (low + F.when(up, 1.0).otherwise(0.0)) / scale


def round_half_even_sql(x: str, digits: int) -> str:
    """The same expression as SQL text for a column name."""
    scale = f"1e{digits}"
    low = f"floor({x} * {scale})"
    half = f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
    over = f"(({half} * (2e0 * {scale}) - ({low} * 2e0 + 1e0)) + ({x} - {half}) * (2e0 * {scale}))"
    return f"(({low} + case when {over} > 0 or ({over} = 0 and {low} % 2 <> 0) then 1e0 else 0e0 end) / {scale})"
