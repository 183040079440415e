"""Drive listings and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.functions.paths import nocase
from archidex.schema import DRIVES, Catalog


def drive_overview(catalog: Catalog) -> DataFrame:
    """Every drive with the counters of its latest snapshot; zeros without one."""
    latest = catalog.snapshots.select(
        F.col("id").alias("latest_snapshot_id"), "file_count", "directory_count", "total_bytes",
        F.col("completed_at").alias("last_scanned_at"),
    )
    counters = ("file_count", "directory_count", "total_bytes", "last_scanned_at")
    return catalog.drives.join(latest, "latest_snapshot_id", "left").select(
        *[f.name for f in DRIVES],
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counters],
    )


def list_drives(catalog: Catalog) -> DataFrame:
    return drive_overview(catalog).orderBy(nocase(F.col("name")), "id")


def recent_drives(catalog: Catalog) -> DataFrame:
    """Newest scan first; drives never scanned come last, equals by name."""
    return drive_overview(catalog).orderBy(F.col("last_scanned_at").desc(), nocase(F.col("name")), "id")


def resolve_drive(catalog: Catalog, id_or_name: str) -> DataFrame:
    """The drive with that id, else with that name in any ASCII case; at most one row."""
    by_id = F.col("id") == id_or_name
    by_name = nocase(F.col("name")) == nocase(F.lit(id_or_name))
    return drive_overview(catalog).where(by_id | by_name).orderBy(by_id.desc(), "id").limit(1)


def get_drive(catalog: Catalog, drive_id: str) -> DataFrame:
    return drive_overview(catalog).where(F.col("id") == drive_id)
