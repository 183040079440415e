"""Snapshot lifecycle and the drive dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archidex.functions.paths import nocase, trim_space
from archidex.functions.tags import normalize_tags
from archidex.schema import DRIVES, SNAPSHOTS, STALE_SCAN_MESSAGE, STALE_SCAN_SECONDS, Catalog, CatalogError, conform
from archidex.session import cut_lineage

PATCH_FIELDS = ("name", "location", "notes", "source_path")


def entry_counters(entries: DataFrame) -> DataFrame:
    """files, directories and bytes per snapshot; symlinks count as neither."""
    is_file = F.col("kind") == "file"
    return entries.groupBy("snapshot_id").agg(
        F.count_if(is_file).alias("file_count"),
        F.count_if(F.col("kind") == "directory").alias("directory_count"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("total_bytes"),
    )


def apply_counters(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """Snapshots with the counters of those that have rows in ``entries`` replaced."""
    counted = entry_counters(entries).select(
        F.col("snapshot_id").alias("id"),
        *[F.col(c).alias(f"_{c}") for c in ("file_count", "directory_count", "total_bytes")],
    )
    joined = snapshots.join(counted, "id", "left")
    fresh = {
        c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("file_count", "directory_count", "total_bytes")
    }
    return joined.select(*[fresh.get(f.name, F.col(f.name)).alias(f.name) for f in SNAPSHOTS])


def consecutive(df: DataFrame, column: str, start: int, group: str, *order: str) -> DataFrame:
    """Number rows from ``start + 1`` by (group, order).

    Only one count per group passes through a single task; the rows are
    numbered inside their groups.
    """
    counts = df.groupBy(group).count()
    before = F.sum("count").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, F.coalesce(before, F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    numbered = df.withColumn("_place", place).join(offsets, group)
    return numbered.withColumn(column, F.lit(start).cast("long") + F.col("_offset") + F.col("_place")).drop(
        "_offset", "_place"
    )


def next_snapshot_base(snapshots: DataFrame) -> int:
    return snapshots.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]


def number_scans(catalog: Catalog, headers: DataFrame) -> DataFrame:
    """Scan headers with new snapshot ids; unknown drives are an error."""
    unknown = headers.join(catalog.drives, headers["drive_id"] == catalog.drives["id"], "left_anti").head()
    if unknown is not None:
        raise CatalogError(f"a scan names the unknown drive {unknown['drive_id']}")
    base = next_snapshot_base(catalog.snapshots)
    return consecutive(headers, "id", base, "drive_id", "started_at", "scan_key")


def started_rows(numbered: DataFrame) -> DataFrame:
    """Rows of scans that are under way; what they will hold is not known yet."""
    return conform(
        numbered.withColumns({
            "status": F.lit("scanning"), "completed_at": F.lit(None), "failure": F.lit(""),
            "file_count": F.lit(0), "directory_count": F.lit(0), "total_bytes": F.lit(0), "error_count": F.lit(0),
        }),
        SNAPSHOTS,
    )


def settled(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """``snapshots`` with the rows of the same ids replaced by ``rows``."""
    return snapshots.join(rows.select("id"), "id", "left_anti").select(*[f.name for f in SNAPSHOTS]).unionByName(rows)


def completed_rows(numbered: DataFrame, now: int) -> DataFrame:
    return conform(
        numbered.withColumns({
            "status": F.lit("complete"), "completed_at": F.lit(now), "failure": F.lit(""),
            "file_count": F.lit(0), "directory_count": F.lit(0), "total_bytes": F.lit(0),
        }),
        SNAPSHOTS,
    )


def failed_rows(numbered: DataFrame, message: str, now: int) -> DataFrame:
    return conform(
        numbered.withColumns({
            "status": F.lit("failed"), "completed_at": F.lit(now), "failure": F.lit(message or "scan failed"),
            "file_count": F.lit(0), "directory_count": F.lit(0), "total_bytes": F.lit(0), "error_count": F.lit(0),
        }),
        SNAPSHOTS,
    )


def point_to_latest(drives: DataFrame, numbered: DataFrame, now: int) -> DataFrame:
    """Drives pointing to the newest of their just completed scans."""
    newest = numbered.groupBy(F.col("drive_id").alias("id")).agg(
        F.max("id").alias("_snapshot"), F.max_by("source_path", "id").alias("_source")
    )
    touched = F.col("_snapshot").isNotNull()
    return drives.join(newest, "id", "left").select(*[
        {
            "latest_snapshot_id": F.coalesce(F.col("_snapshot"), F.col("latest_snapshot_id")),
            "source_path": F.coalesce(F.col("_source"), F.col("source_path")),
            "updated_at": F.when(touched, F.lit(now)).otherwise(F.col("updated_at")),
        }.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in DRIVES
    ])


def _stale(now: int) -> Column:
    return (F.col("status") == "scanning") & (F.col("started_at") < now - STALE_SCAN_SECONDS)


def stale_snapshots(snapshots: DataFrame, now: int) -> DataFrame:
    return snapshots.where(_stale(now))


def recover_stale(snapshots: DataFrame, now: int) -> DataFrame:
    """Scans still open after a day become failed."""
    stale = _stale(now)
    return snapshots.withColumns({
        "completed_at": F.when(stale, F.lit(now).cast("long")).otherwise(F.col("completed_at")),
        "failure": F.when(stale, F.lit(STALE_SCAN_MESSAGE)).otherwise(F.col("failure")),
        "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
    })


def name_clashes(drives: DataFrame) -> DataFrame:
    """Case-insensitive names held by more than one drive."""
    return drives.groupBy(nocase(F.col("name")).alias("name_key")).count().where(F.col("count") > 1)


def prepared_drives(new_drives: DataFrame, now: int) -> DataFrame:
    """New drive rows: trimmed fields, normalized tags, a fresh random id unless one is given."""
    present = set(new_drives.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in present else F.lit("")

    random_id = F.concat(F.lit("drv_"), F.left(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), F.lit(12)))
    no_tags = F.array().cast("array<string>")
    return conform(
        new_drives.select(
            (F.col("id") if "id" in present else random_id).alias("id"),
            trim_space(F.col("name")).alias("name"),
            text("source_path").alias("source_path"),
            trim_space(text("location")).alias("location"),
            trim_space(text("notes")).alias("notes"),
            normalize_tags(F.coalesce(F.col("tags"), no_tags) if "tags" in present else no_tags).alias("tags"),
            text("fingerprint").alias("fingerprint"),
            F.lit(now).alias("created_at"),
            F.lit(now).alias("updated_at"),
        ),
        DRIVES,
    )


def create_drives(drives: DataFrame, new_drives: DataFrame, now: int) -> DataFrame:
    """``drives`` with new ones added; blank and already used names are errors."""
    # Random ids have to be drawn once, so the prepared rows are written out.
    fresh = cut_lineage(prepared_drives(new_drives, now))
    if not fresh.where(F.col("name").isNull() | (F.col("name") == "")).isEmpty():
        raise CatalogError("a new drive has a blank name")
    combined = drives.unionByName(fresh)
    _refuse_clashes(combined)
    repeated = combined.groupBy("id").count().where("count > 1").head()
    if repeated is not None:
        raise CatalogError(f"drive id {repeated['id']} would stand for two drives")
    return combined


def _refuse_clashes(drives: DataFrame) -> None:
    clash = name_clashes(drives).head()
    if clash is not None:
        raise CatalogError(f"drive name {clash['name_key']!r} would stand for {clash['count']} drives")


def patched_drives(drives: DataFrame, patches: DataFrame, now: int) -> DataFrame:
    """``drives`` with the non-null fields of ``patches`` (by id) applied."""
    present = [c for c in (*PATCH_FIELDS, "tags") if c in patches.columns]
    renamed = patches.select(F.col("id"), F.lit(True).alias("_patched"), *[F.col(c).alias(f"_{c}") for c in present])

    def value(name: str) -> Column:
        if name == "updated_at":
            return F.when(F.col("_patched"), F.lit(now).cast("long")).otherwise(F.col(name))
        if name not in present:
            return F.col(name)
        new = normalize_tags(F.col("_tags")) if name == "tags" else trim_space(F.col(f"_{name}"))
        return F.coalesce(new, F.col(name))

    return drives.join(renamed, "id", "left").select(*[value(f.name).alias(f.name) for f in DRIVES])


def update_drives(drives: DataFrame, patches: DataFrame, now: int) -> DataFrame:
    """Checked form of ``patched_drives``: known ids, no blank and no clashing name."""
    missing = patches.join(drives, "id", "left_anti").head()
    if missing is not None:
        raise CatalogError(f"a patch names the unknown drive {missing['id']}")
    repeated = patches.groupBy("id").count().where("count > 1").head()
    if repeated is not None:
        raise CatalogError(f"drive {repeated['id']} has {repeated['count']} patches")
    updated = patched_drives(drives, patches, now)
    if not updated.where(F.col("name") == "").isEmpty():
        raise CatalogError("a patch leaves a drive with a blank name")
    _refuse_clashes(updated)
    return updated
