"""Rounding and small numeric helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, decimals: int = 0) -> Column:
    """Half away from zero; integers come back as BIGINT, decimals as DOUBLE."""
    factor = float(10**decimals)
    scaled = value.cast("double") * F.lit(factor)
    rounded = F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(-F.floor(0.5 - scaled))
    return (rounded / F.lit(factor)) if decimals else rounded.cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, 0 when there is nothing to divide by."""
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0).cast("bigint"))


def percent_or_null(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_half_up(part / whole * 100))


def spanish_number(value: Column, decimals: int) -> Column:
    """``1234.5`` -> ``1.234,5``; four-digit integers stay ungrouped as in es-ES."""
    rounded = round_half_up(value, decimals) if decimals else round_half_up(value)
    text = F.translate(F.format_number(rounded, decimals), ",.", ".,")
    return F.when(F.abs(rounded) < 10000, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
