"""Table schemas, fixed limits and the catalog handle."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2
EXPORT_VERSION = 1
STALE_SCAN_SECONDS = 24 * 60 * 60
# Fixed value: what a stale scan is stored with.
STALE_SCAN_MESSAGE = "scan interrupted before completion"

STATUSES = ("scanning", "complete", "failed")
KINDS = ("file", "directory", "symlink")
HASH_MODES = ("none", "quick", "full", "imported", "demo")

# Fixed values: (default, maximum) rows of every page; a value outside 1..maximum means the default.
# Only pages are bounded: each has a whole form without a limit (duplicates_all, diff_all, ...).
LIMITS = {
    "entries": (250, 1000),
    "search": (100, 500),
    "extensions": (12, 100),
    "diff": (1000, 5000),
    "duplicates": (50, 200),
}

# A dimension table is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 200_000

DRIVES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("latest_snapshot_id", T.LongType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("updated_at", T.LongType()),
])

SNAPSHOTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("drive_id", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("hash_mode", T.StringType()),
    T.StructField("file_count", T.LongType()),
    T.StructField("directory_count", T.LongType()),
    T.StructField("total_bytes", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("started_at", T.LongType()),
    T.StructField("completed_at", T.LongType()),
    T.StructField("failure", T.StringType()),
])

ENTRIES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("snapshot_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("modified_at", T.LongType()),
    T.StructField("hash", T.StringType()),
    T.StructField("hidden", T.BooleanType()),
])

IMPORTS = T.StructType([
    T.StructField("digest", T.StringType()),
    T.StructField("target_snapshot_id", T.LongType()),
    T.StructField("trusted_full_hashes", T.BooleanType()),
    T.StructField("imported_at", T.LongType()),
])

POSTINGS = T.StructType([
    T.StructField("suffix", T.StringType()),
    T.StructField("snapshot_id", T.LongType()),
    T.StructField("entry_id", T.LongType()),
    T.StructField("in_name", T.BooleanType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("name", T.StringType()),
])


class CatalogError(ValueError):
    """A request or a source catalog that breaks a catalog rule."""


def bounded(kind: str, limit: int | None) -> int:
    """The rows of a page. A limit out of range falls back to the default, with a warning; it does not clamp."""
    default, maximum = LIMITS[kind]
    if limit is None or 1 <= limit <= maximum:
        return default if limit is None else limit
    warnings.warn(f"{kind}: limit {limit} is not in 1..{maximum}; the page has {default} rows", stacklevel=3)
    return default


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; absent columns become nulls."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Catalog:
    """The four tables of one catalog version.

    ``drive_rows`` / ``snapshot_rows`` are counts recorded when the version was
    published; they are what allows a broadcast of a dimension table.
    """

    drives: DataFrame
    snapshots: DataFrame
    entries: DataFrame
    imports: DataFrame
    version: int = SCHEMA_VERSION
    location: str | None = None
    drive_rows: int | None = None
    snapshot_rows: int | None = None
    postings: DataFrame | None = field(default=None)
    postings_stats: DataFrame | None = field(default=None)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def with_(self, **changes) -> "Catalog":
        return replace(self, **changes)

    def small_drives(self, df: DataFrame) -> DataFrame:
        """Broadcast a frame with at most one row per drive if the drive count allows it."""
        return _hint(df, self.drive_rows)

    def small_snapshots(self, df: DataFrame) -> DataFrame:
        """Broadcast a frame with at most one row per snapshot if the count allows it."""
        return _hint(df, self.snapshot_rows)

    def current_drives(self, drive_id: str | None = None) -> DataFrame:
        """Drives that have a latest snapshot.

        The comparison with zero is always true for an assigned id; it also
        makes the drive side eligible to prune entry partitions at run time.
        """
        drives = self.drives.where(F.col("latest_snapshot_id") > 0)
        return drives if drive_id is None else drives.where(F.col("id") == drive_id)

    def current_entries(self, *columns: str, drive_id: str | None = None) -> DataFrame:
        """Entries of every drive's latest snapshot with the drive columns beside them."""
        keep = list(columns) or [f.name for f in ENTRIES]
        wanted = dict.fromkeys(["snapshot_id", *keep])
        drives = self.current_drives(drive_id).select(
            F.col("latest_snapshot_id").alias("snapshot_id"),
            F.col("id").alias("drive_id"),
            F.col("name").alias("drive_name"),
            "location",
        )
        return self.entries.select(*wanted).join(self.small_drives(drives), "snapshot_id")


def _hint(df: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df
