"""Catalog statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.schema import Catalog, bounded

_STATS = ("drive_count", "snapshot_count", "file_count", "directory_count", "total_bytes", "hashed_file_count")


def stats(catalog: Catalog) -> DataFrame:
    """One row of totals.

    Counters come from the snapshots table; only the count of fingerprinted
    files reads entries, and it reads two columns of the current view. The
    parts are one-row aggregates, added up by a last aggregate.
    """
    zero = F.lit(0).cast("long")

    def part(df: DataFrame, **values) -> DataFrame:
        return df.agg(*[F.coalesce(values.get(c, F.lit(None)), zero).cast("long").alias(c) for c in _STATS])

    counters = catalog.snapshots.select(
        F.col("id").alias("latest_snapshot_id"), "file_count", "directory_count", "total_bytes"
    )
    drives = catalog.drives.select("id", "latest_snapshot_id").join(counters, "latest_snapshot_id", "left")
    hashed = catalog.current_entries("kind", "hash").where((F.col("kind") == "file") & (F.col("hash") != ""))
    parts = [
        part(
            drives,
            drive_count=F.count(F.lit(1)),
            file_count=F.sum("file_count"),
            directory_count=F.sum("directory_count"),
            total_bytes=F.sum("total_bytes"),
        ),
        part(catalog.snapshots, snapshot_count=F.count_if(F.col("status") == "complete")),
        part(hashed, hashed_file_count=F.count(F.lit(1))),
    ]
    return reduce(DataFrame.unionAll, parts).agg(*[F.sum(c).alias(c) for c in _STATS])


def _by_extension(catalog: Catalog, drive_id: str | None) -> DataFrame:
    files = catalog.current_entries("extension", "kind", "size", drive_id=drive_id).where(F.col("kind") == "file")
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("bytes"))


def _labelled(grouped: DataFrame) -> DataFrame:
    label = F.when(F.col("extension") == "", "(none)").otherwise(F.col("extension"))
    return grouped.select(label.alias("extension"), "count", "bytes")


def extension_stats_all(catalog: Catalog, drive_id: str | None = None) -> DataFrame:
    """Current files of every extension, in no order.

    Grouping is on the stored value, so a file extension spelled like the
    label of the empty one keeps a row of its own.
    """
    return _labelled(_by_extension(catalog, drive_id))


def extension_stats(catalog: Catalog, drive_id: str | None = None, limit: int | None = None) -> DataFrame:
    """A page of the extensions with most bytes, largest total first."""
    top = _by_extension(catalog, drive_id).orderBy(F.col("bytes").desc(), "extension")
    return _labelled(top.limit(bounded("extensions", limit)))
