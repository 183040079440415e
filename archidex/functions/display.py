"""Presentation of numbers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal byte units.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _fixed(amount: Column, decimals: int) -> Column:
    """Rounded text of a double; ties are judged on its binary value, then go to even."""
    return F.replace(F.format_number(amount, decimals), F.lit(","), F.lit(""))


def human_bytes(value: Column, decimals: int = 2) -> Column:
    """Decimal units; plain bytes below one kilobyte, petabytes as the last step."""
    text = F.concat(value.cast("string"), F.lit(" B"))
    for power, unit in enumerate(BYTE_UNITS[1:], start=1):
        amount = value.cast("double")
        for _ in range(power):
            amount = amount / F.lit(1000.0)
        scaled = F.concat(_fixed(amount, decimals), F.lit(f" {unit}"))
        text = F.when(value >= F.lit(1000**power), scaled).otherwise(text)
    return text


def human_count(value: Column) -> Column:
    thousands = F.concat(_fixed(value.cast("double") / 1000.0, 1), F.lit("k"))
    millions = F.concat(_fixed(value.cast("double") / 1_000_000.0, 1), F.lit("M"))
    return F.when(value >= 1_000_000, millions).when(value >= 1000, thousands).otherwise(value.cast("string"))


def shorten(value: Column, width: int) -> Column:
    cut = F.concat(F.left(value, F.lit(width - 1)), F.lit("…"))
    return F.when(F.length(value) > width, cut).otherwise(value)
