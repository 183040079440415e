"""Lenient fields of file lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archidex.functions.paths import forward_slashes, trim_space

LONG_MAX = 2**63 - 1
LONG_MIN = -(2**63)
INTEGER_PATTERN = "^[+-]?[0-9]+$"

# 100 ns ticks between 1601 and 1970, and ticks per second.
FILETIME_EPOCH = 116_444_736_000_000_000
FILETIME_TICKS = 10_000_000

# Accepted time texts, tried in this order, as (shape, Spark pattern).
TIME_LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$", None),
    (r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}([.,]\d+)?$", "yyyy-MM-dd H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} (AM|PM)$", "M/d/yyyy h:mm a"),
    (r"^\d{2}/\d{2}/\d{4} \d{1,2}:\d{2}$", "dd/MM/yyyy H:mm"),
)


def windows_path(value: Column) -> Column:
    """Outer quotes and space off, forward slashes, no doubled or final slash."""
    plain = forward_slashes(trim_space(F.trim(value, F.lit('"'))))
    return F.regexp_replace(F.regexp_replace(plain, "/{2,}", "/"), r"/\z", "")


def strip_leading(path: Column, prefix: Column) -> Column:
    """Drop ``prefix`` (a plain string prefix, not a path segment), then leading slashes."""
    rest = F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
    return F.ltrim(rest, F.lit("/"))


def _saturated(text: Column) -> Column:
    """Integer text as decimal, beyond-range values pulled to the nearest long."""
    number = F.coalesce(
        text.try_cast("decimal(38,0)"),
        F.when(F.startswith(text, F.lit("-")), F.lit(LONG_MIN).cast("decimal(38,0)")).otherwise(
            F.lit(LONG_MAX).cast("decimal(38,0)")
        ),
    )
    low, high = (F.lit(v).cast("decimal(38,0)") for v in (LONG_MIN, LONG_MAX))
    return F.least(F.greatest(number, low), high)


def lenient_size(value: Column) -> Column:
    """Integer text as a saturated long; anything else is zero."""
    text = trim_space(F.coalesce(value, F.lit("")))
    return F.when(text.rlike(INTEGER_PATTERN), _saturated(text).cast("long")).otherwise(F.lit(0).cast("long"))


def lenient_time(value: Column, zone: str | None = None) -> Column:
    """Unix seconds of a file-list time: FILETIME, unix seconds or a known text; else 0."""
    text = trim_space(F.coalesce(value, F.lit("")))
    number = F.when(text.rlike(INTEGER_PATTERN), text.try_cast("long"))
    parsed = [_time_of(text, shape, pattern, zone) for shape, pattern in TIME_LAYOUTS]
    ticks = number.cast("decimal(20,0)") - F.lit(FILETIME_EPOCH).cast("decimal(20,0)")
    seconds = (
        F.when(number > FILETIME_EPOCH, F.floor(ticks / F.lit(FILETIME_TICKS).cast("decimal(20,0)")).cast("long"))
        .when(number > 0, number)
        .otherwise(F.coalesce(*parsed))
    )
    return F.coalesce(seconds, F.lit(0)).cast("long")


def _time_of(text: Column, shape: str, pattern: str | None, zone: str | None) -> Column:
    plain = F.regexp_replace(text, "[.,][0-9]+", "")
    if pattern is None:
        moment = plain.try_cast("timestamp")
    elif zone is None:
        moment = F.try_to_timestamp(plain, F.lit(pattern))
    else:
        moment = F.try_to_timestamp(F.concat(plain, F.lit(f" {zone}")), F.lit(f"{pattern} VV"))
    return F.when(text.rlike(shape), F.unix_timestamp(moment))
