"""Snapshot comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archidex.functions.fingerprints import FULL, QUICK, has_scheme
from archidex.functions.paths import nocase
from archidex.operators.browse import history_order
from archidex.schema import Catalog, CatalogError, bounded

_COMPARED = ("kind", "size", "modified_at", "hash")


def _content_differs() -> Column:
    """Unequal fingerprints of one scheme; a change of scheme alone proves nothing."""
    same_scheme = [
        has_scheme(F.col("old.hash"), scheme) & has_scheme(F.col("new.hash"), scheme) for scheme in (FULL, QUICK)
    ]
    return (same_scheme[0] | same_scheme[1]) & (F.col("old.hash") != F.col("new.hash"))


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two entry sets by ``keys``, whose last one is the path.

    A path is unique on either side, so the join has no hot key however the
    entries are spread over snapshots.
    """
    sides = []
    for side, df in (("old", old), ("new", new)):
        sides.append(df.select(*keys, F.struct(*_COMPARED).alias(side)))
    joined = sides[0].join(sides[1], keys, "full_outer")
    changed = (
        (F.col("old.kind") != F.col("new.kind"))
        | (F.col("old.size") != F.col("new.size"))
        | (F.col("old.modified_at") != F.col("new.modified_at"))
        | _content_differs()
    )
    change = (
        F.when(F.col("new").isNull(), "removed")
        .when(F.col("old").isNull(), "added")
        .when(changed, "changed")
    )
    return joined.select(
        *keys,
        change.alias("change"),
        F.coalesce(F.col("new.kind"), F.col("old.kind")).alias("kind"),
        F.col("old.size").alias("old_size"),
        F.col("new.size").alias("new_size"),
        F.col("old.modified_at").alias("old_modified"),
        F.col("new.modified_at").alias("new_modified"),
    ).where(F.col("change").isNotNull())


def diff_all(catalog: Catalog, from_id: int, to_id: int) -> DataFrame:
    """All differences of two snapshots, in no order."""
    old = catalog.entries.where(F.col("snapshot_id") == from_id)
    new = catalog.entries.where(F.col("snapshot_id") == to_id)
    return compare(old, new, ["path"])


def diff(catalog: Catalog, drive_id: str, from_id: int, to_id: int, limit: int | None = None) -> DataFrame:
    """First differences, in path order, of two complete snapshots of one drive."""
    wanted = {from_id, to_id}
    usable = catalog.snapshots.where(
        F.col("id").isin(list(wanted)) & (F.col("drive_id") == drive_id) & (F.col("status") == "complete")
    )
    if usable.select("id").distinct().count() != len(wanted):
        raise CatalogError(f"drive {drive_id}: only two of its own complete snapshots can be compared")
    changes = diff_all(catalog, from_id, to_id)
    return changes.orderBy(nocase(F.col("path")), "path").limit(bounded("diff", limit))


def latest_pairs(catalog: Catalog) -> DataFrame:
    """(drive_id, old_id, new_id) of the two newest complete snapshots per drive."""
    newest = Window.partitionBy("drive_id").orderBy(*history_order())
    complete = catalog.snapshots.where(F.col("status") == "complete")
    ranked = complete.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= 2)
    return (
        ranked.groupBy("drive_id")
        .agg(
            F.max(F.when(F.col("place") == 2, F.col("id"))).alias("old_id"),
            F.max(F.when(F.col("place") == 1, F.col("id"))).alias("new_id"),
        )
        .where(F.col("old_id").isNotNull())
    )


def diff_latest_two(catalog: Catalog, drive_id: str | None = None) -> DataFrame:
    """Changes between the two newest complete snapshots of every drive, in one job."""
    pairs = latest_pairs(catalog)
    if drive_id is not None:
        pairs = pairs.where(F.col("drive_id") == drive_id)

    def side(column: str) -> DataFrame:
        chosen = pairs.where(F.col(column) > 0).select("drive_id", F.col(column).alias("snapshot_id"))
        return catalog.entries.join(catalog.small_drives(chosen), "snapshot_id")

    return compare(side("old_id"), side("new_id"), ["drive_id", "path"])
