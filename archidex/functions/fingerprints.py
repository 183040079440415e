"""Content fingerprints and tests on stored ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archidex.functions.paths import nocase

# Scheme prefixes and the sample length of the quick scheme.
FULL = "sha256:"
QUICK = "quick:"
QUICK_SAMPLE = 64 * 1024
FINGERPRINT_PATTERN = "^(quick|sha256):[0-9a-f]{64}$"


def has_scheme(value: Column, scheme: str) -> Column:
    """Whether the fingerprint starts with the scheme, in any ASCII case."""
    return F.startswith(value, F.lit(scheme)) | (nocase(F.left(value, F.lit(len(scheme)))) == scheme)


def packed(value: Column) -> Column:
    """A stored fingerprint in as few bytes as it needs: a byte for the scheme, then the digest or, for any other text, that text."""
    scheme = F.when(F.startswith(value, F.lit(FULL)), F.lit(b"\2")).otherwise(F.lit(b"\1"))
    # \\z and not $, which a line break may follow.
    usual = F.rlike(value, F.lit(FINGERPRINT_PATTERN.removesuffix("$") + "\\z"))
    return F.when(usual, F.concat(scheme, F.unhex(F.right(value, F.lit(64))))).otherwise(F.concat(F.lit(b"\0"), value.cast("binary")))


def unpacked(value: Column) -> Column:
    """The fingerprint that ``packed`` made the bytes from."""
    scheme, rest = F.substring(value, 1, 1), F.substring(value, 2, (1 << 31) - 1)
    usual = F.concat(F.when(scheme == F.lit(b"\2"), FULL).otherwise(QUICK), F.lower(F.hex(rest)))
    return F.when(scheme == F.lit(b"\0"), rest.cast("string")).otherwise(usual)


def full_fingerprint(content: Column) -> Column:
    return F.concat(F.lit(FULL), F.sha2(content, 256))


def little_endian_64(value: Column) -> Column:
    """Eight bytes of a non-negative long, least significant first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    pairs = [F.substring(digits, 15 - 2 * i, 2) for i in range(8)]
    return F.unhex(F.concat(*pairs))


def quick_fingerprint(content: Column, size: Column | None = None) -> Column:
    """Length, first sample and the last sample that does not overlap the first."""
    size = F.octet_length(content).cast("long") if size is None else size
    tail_start = F.greatest(size - QUICK_SAMPLE, F.lit(QUICK_SAMPLE)).cast("int") + 1
    tail = F.when(size > QUICK_SAMPLE, F.substring(content, tail_start, F.lit(QUICK_SAMPLE))).otherwise(F.lit(b""))
    head = F.substring(content, 1, QUICK_SAMPLE)
    return F.concat(F.lit(QUICK), F.sha2(F.concat(little_endian_64(size), head, tail), 256))
