"""Snapshot history, folder pages and whole snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.functions.paths import catalog_path, nocase
from archidex.schema import ENTRIES, Catalog, bounded

_ENTRY_COLUMNS = [f.name for f in ENTRIES]


def history_order() -> list[Column]:
    return [F.coalesce(F.col("completed_at"), F.col("started_at")).desc(), F.col("id").desc()]


def snapshot_history(catalog: Catalog, drive_id: str | None = None) -> DataFrame:
    """Snapshots of one drive (or of each drive in turn), newest first."""
    if drive_id is None:
        return catalog.snapshots.orderBy("drive_id", *history_order())
    return catalog.snapshots.where(F.col("drive_id") == drive_id).orderBy(*history_order())


def get_snapshot(catalog: Catalog, snapshot_id: int) -> DataFrame:
    return catalog.snapshots.where(F.col("id") == snapshot_id)


def _folder_order() -> list[Column]:
    return [F.when(F.col("kind") == "directory", 0).otherwise(1), nocase(F.col("name")), F.col("path")]


def list_entries(
    catalog: Catalog, snapshot_id: int, parent: str = "", limit: int | None = None, offset: int = 0
) -> DataFrame:
    """One page of a folder: directories first, then by name."""
    page = catalog.entries.where(
        (F.col("snapshot_id") == snapshot_id) & (F.col("parent_path") == catalog_path(F.lit(parent)))
    )
    ordered = page.select(*_ENTRY_COLUMNS).orderBy(*_folder_order())
    return ordered.offset(max(offset, 0)).limit(bounded("entries", limit))


def list_latest_entries(
    catalog: Catalog, drive_id: str, parent: str = "", limit: int | None = None, offset: int = 0
) -> DataFrame:
    """One page of a folder in a drive's latest snapshot; empty without one."""
    page = catalog.current_entries(drive_id=drive_id).where(F.col("parent_path") == catalog_path(F.lit(parent)))
    ordered = page.select(*_ENTRY_COLUMNS).orderBy(*_folder_order())
    return ordered.offset(max(offset, 0)).limit(bounded("entries", limit))


def snapshot_entries(catalog: Catalog, snapshot_id: int) -> DataFrame:
    """A whole snapshot in path order."""
    return catalog.entries.where(F.col("snapshot_id") == snapshot_id).select(*_ENTRY_COLUMNS).orderBy("path")


def breadcrumbs(paths: DataFrame, root_label: Column | None = None) -> DataFrame:
    """The chain of folders to each ``path``: a root crumb, then one per segment.

    Other columns of ``paths`` are kept; ``depth`` 0 is the root.
    """
    root = F.lit("") if root_label is None else root_label
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    crumb = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(
            n.alias("depth"),
            F.when(n == 0, root).otherwise(F.get(parts, n - 1)).alias("label"),
            F.array_join(F.slice(parts, F.lit(1), n), "/").alias("crumb_path"),
        ),
    )
    return paths.select(*paths.columns, F.inline(crumb))
