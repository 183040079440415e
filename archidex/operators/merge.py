"""Merging another catalog into this one.

The merge is computed as frames over all drives and snapshots at once and
changes nothing until its result is published; a preview is the same
computation without the publish.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archidex.functions.fingerprints import FULL, has_scheme
from archidex.functions.paths import nocase
from archidex.operators import validate
from archidex.operators.digest import snapshot_digests, snapshot_summary
from archidex.operators.lifecycle import consecutive, next_snapshot_base
from archidex.schema import DRIVES, ENTRIES, IMPORTS, SNAPSHOTS, Catalog, CatalogError, conform
from archidex.session import cut_lineage
from archidex.sources.store import CatalogStore, check_schema_version

MAX_NAME_ATTEMPTS = 10_000


@dataclass(frozen=True)
class MergePlan:
    """Everything a merge would write, and its report."""

    drives: DataFrame
    snapshots: DataFrame
    imports: DataFrame
    new_entries: DataFrame
    replaced_entries: DataFrame
    renames: DataFrame
    report: DataFrame


# -- drives --------------------------------------------------------------------


def _marked(name: Column, drive_id: Column) -> Column:
    """The name with its mark; numbered marks are this with a number behind it."""
    return F.concat(name, F.lit(" (imported "), F.right(F.replace(drive_id, F.lit("drv_"), F.lit("")), F.lit(6)), F.lit(")"))


def _candidate(name: Column, drive_id: Column, attempt: Column) -> Column:
    """Name number ``attempt``: the own one, then the marked one, then numbered marks."""
    marked = _marked(name, drive_id)
    return F.when(attempt == 0, name).when(attempt == 1, marked).otherwise(
        F.concat(marked, F.lit(" "), attempt.cast("string"))
    )


def _standing(proposals: DataFrame, taken: DataFrame) -> DataFrame:
    """Proposals with ``refused``: the name is taken, or asked for by a smaller id."""
    named = proposals.withColumn("name_key", nocase(_candidate(F.col("name"), F.col("id"), F.col("attempt"))))
    first = F.min("id").over(Window.partitionBy("name_key"))
    return (
        named.join(taken.withColumn("taken", F.lit(True)), "name_key", "left")
        .withColumn("refused", F.coalesce(F.col("taken"), F.lit(False)) | (first != F.col("id")))
        .drop("taken", "name_key")
    )


def _places(names: DataFrame) -> DataFrame:
    """Where a name stands in series of marked names: place 1 of its own, place n of the one it numbers."""
    numbered = rf"(?s)^(.*) ([2-9]|[1-9][0-9]{{1,{len(str(MAX_NAME_ATTEMPTS)) - 1}}})\z"
    own = names.withColumns({"series": F.col("name_key"), "place": F.lit(1)})
    tail = names.where(F.col("name_key").rlike(numbered)).withColumns({
        "series": F.regexp_extract("name_key", numbered, 1),
        "place": F.regexp_extract("name_key", numbered, 2).cast("int"),
    })
    return own.unionByName(tail).drop("name_key")


def _moved(proposals: DataFrame, taken: DataFrame) -> DataFrame:
    """The next names of drives that lost their own one.

    Such drives fill their series in id order, each taking the first free place. The places that are not free to any of
    them (names of the target, and names now held by a smaller id outside the series) leave gaps; the k-th drive can't get
    a gap before the k-th, nor one before its predecessor's next. Both are lower bounds, so no free name is passed over.
    """
    name, drive = F.col("name"), F.col("id")
    members = proposals.where("refused or attempt > 0").withColumn("series", nocase(_marked(name, drive)))
    first = members.groupBy("series").agg(F.min("id").alias("first_id"))
    holders = proposals.where("not refused").select(
        nocase(_candidate(name, drive, F.col("attempt"))).alias("name_key"), F.col("id").alias("holder"),
        F.when(F.col("attempt") > 0, nocase(_marked(name, drive))).alias("home"),
    )
    everyone = taken.withColumns({"holder": F.lit(None).cast("string"), "home": F.lit(None).cast("string")})
    closed = _places(everyone.unionByName(holders)).join(first, "series").where(
        F.col("holder").isNull() | ((F.col("holder") < F.col("first_id")) & ~F.col("home").eqNullSafe(F.col("series")))
    )
    closed = closed.select("series", "place").distinct()
    # Gaps before a closed place, and closed places up to each drive's present one.
    in_series = Window.partitionBy("series")
    before = closed.withColumn("gap", F.col("place") - F.row_number().over(in_series.orderBy("place")))
    asking = members.withColumns({"place": F.col("attempt"), "is_drive": F.lit(1)})
    along = in_series.orderBy("place", "is_drive").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asking.unionByName(closed.withColumn("is_drive", F.lit(0)), allowMissingColumns=True)
    placed = both.withColumn("passed", F.sum(1 - F.col("is_drive")).over(along)).where("is_drive = 1")
    at = closed.withColumn("on_closed", F.lit(True))
    placed = placed.join(at, ["series", "place"], "left").withColumn("on_closed", F.coalesce("on_closed", F.lit(False)))
    # Its gap now; a refused drive, and one whose place is closed, stands before the next.
    stands = F.col("place") - F.col("passed") + (F.col("refused") | F.col("on_closed")).cast("int")
    by_id = in_series.orderBy("id")
    upto = by_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumns({"stands": stands, "rank": F.row_number().over(by_id)})
    ahead = ranked.withColumn("gap", F.max(F.col("stands") - F.col("rank")).over(upto) + F.col("rank"))
    ahead = ahead.select("id", "name", "series", "gap").withColumn("is_drive", F.lit(1))
    # The gap's place: closed places with fewer gaps before them come first.
    lined = ahead.unionByName(before.select("series", "gap").withColumn("is_drive", F.lit(0)), allowMissingColumns=True)
    order = in_series.orderBy("gap", F.col("is_drive").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = lined.withColumn("attempt", F.col("gap") + F.sum(1 - F.col("is_drive")).over(order)).where("is_drive = 1")
    return found.select("id", "name", F.col("attempt").cast("int").alias("attempt"))


def assign_names(target: DataFrame, source: DataFrame) -> DataFrame:
    """Source drives unknown to the target with the names they get: id, name, attempt.

    A name goes to the smallest id that asks for it; drives that lose their own name are dealt the free places of their
    series of marked names by rank, all at once. The result is that of adding the drives one after the other in id order.
    Clashes within a series take no further step, however many; only a name that one series takes from another,
    or from a drive's own name, takes one more.
    """
    taken = target.select(nocase(F.col("name")).alias("name_key")).distinct()
    unknown = source.join(target.select("id"), "id", "left_anti").select("id", "name")
    proposals = cut_lineage(_standing(unknown.withColumn("attempt", F.lit(0)), taken))
    while not proposals.where("refused").isEmpty():
        moved = cut_lineage(_moved(proposals, taken))
        if not moved.where(F.col("attempt") > MAX_NAME_ATTEMPTS).isEmpty():
            raise CatalogError(f"no free name for an imported drive in {MAX_NAME_ATTEMPTS} tries")
        kept = proposals.where("not refused and attempt = 0").select("id", "name", "attempt")
        proposals = cut_lineage(_standing(kept.unionByName(moved), taken))
    return proposals.select("id", "name", "attempt")


def merge_drives(target: DataFrame, source: DataFrame, rename_conflicts: bool) -> DataFrame:
    """Source drives with ``status`` added or merged, and the name each has in the target."""
    names = assign_names(target, source)
    if not rename_conflicts:
        clash = names.where(F.col("attempt") > 0).orderBy("id").head()
        if clash is not None:
            raise CatalogError(f"drive name {clash['name']!r} of {clash['id']} already belongs to another drive")
    known = target.select("id", F.col("name").alias("known_name"))
    fresh = names.select("id", _candidate(F.col("name"), F.col("id"), F.col("attempt")).alias("new_name"))
    return source.join(known, "id", "left").join(fresh, "id", "left").select(
        "id",
        F.col("name").alias("source_name"),
        F.coalesce("known_name", "new_name").alias("target_name"),
        F.when(F.col("known_name").isNull(), "added").otherwise("merged").alias("status"),
        (F.col("known_name").isNull() & (F.col("new_name") != F.col("name"))).alias("renamed"),
    )


# -- snapshots -----------------------------------------------------------------


def plan_import(digests: DataFrame, source: DataFrame, imports: DataFrame, trust: bool) -> DataFrame:
    """Source snapshots with an action: incomplete, skip, update or import."""
    receipts = imports.select("digest", F.col("target_snapshot_id").alias("known_snapshot"),
                              F.col("trusted_full_hashes").alias("known_trust"))
    keyed = digests.select("id", "digest", "full_hashes", "rows")
    planned = source.join(keyed, "id", "left").join(receipts, "digest", "left")
    action = (
        F.when(F.col("status") != "complete", "incomplete")
        .when(F.col("known_snapshot").isNull(), "import")
        .when(F.col("known_trust") == trust, "skip")
        .otherwise("update")
    )
    return planned.withColumn("action", action)


def remap_snapshots(planned: DataFrame, base: int) -> DataFrame:
    """New target ids for the snapshots to import, in (drive, source id) order."""
    chosen = planned.where(F.col("action") == "import")
    return consecutive(chosen, "target_id", base, "drive_id", "id")


def copied_hash(trust: bool) -> Column:
    """Full-content claims are kept only from a trusted source; quick ones always."""
    value = F.col("hash")
    return value if trust else F.when(has_scheme(value, FULL), "").otherwise(value)


def copied_mode(trust: bool, full_hashes: Column) -> Column:
    stripped = F.lit(not trust) & (F.coalesce(full_hashes, F.lit(0)) > 0)
    return F.when(stripped, "imported").otherwise(F.col("hash_mode"))


def copy_entries(catalog: Catalog, mapping: DataFrame, trust: bool) -> DataFrame:
    """Entries of the mapped source snapshots under their target ids."""
    ids = catalog.small_snapshots(mapping.select(F.col("id").alias("snapshot_id"), "target_id"))
    copied = catalog.entries.join(ids, "snapshot_id")
    return copied.withColumns({"snapshot_id": F.col("target_id"), "hash": copied_hash(trust)}).drop("id", "target_id")


def select_latest(target: Catalog, mapped: DataFrame) -> DataFrame:
    """Drives whose latest snapshot moves: to the newest imported one, unless theirs is newer."""
    newest = mapped.groupBy("drive_id").agg(
        F.max(F.struct("completed_at", "id", "target_id")).alias("newest")
    )
    current = target.drives.join(
        target.snapshots.select(F.col("id").alias("latest_snapshot_id"), F.col("completed_at").alias("current_at")),
        "latest_snapshot_id", "left",
    ).select(F.col("id").alias("drive_id"), "latest_snapshot_id", F.coalesce("current_at", F.lit(0)).alias("current_at"))
    joined = newest.join(current, "drive_id", "left")
    moves = F.col("latest_snapshot_id").isNull() | (F.col("newest.completed_at") >= F.col("current_at"))
    return joined.where(moves).select("drive_id", F.col("newest.target_id").alias("latest_snapshot_id"))


def apply_hash_policy(source: Catalog, target: Catalog, updates: DataFrame, trust: bool) -> DataFrame:
    """Target entries of already imported snapshots with full hashes restored or blanked.

    Source and target have to hold the same paths; a path on one side only
    fails the job that reads the result.
    """
    pairs = updates.select(F.col("id").alias("source_id"), F.col("known_snapshot").alias("snapshot_id"))
    ours = target.entries.join(target.small_snapshots(pairs.select("snapshot_id")), "snapshot_id", "left_semi")
    theirs = source.entries.select(F.col("snapshot_id").alias("source_id"), "path", "hash").join(
        source.small_snapshots(pairs), "source_id"
    ).select("snapshot_id", "path", F.lit(True).alias("in_source"), copied_hash(trust).alias("new_hash"))
    joined = ours.join(theirs, ["snapshot_id", "path"], "full_outer")
    unmatched = F.col("in_source").isNull() | F.col("id").isNull()
    problem = F.concat(F.lit("source and imported snapshot differ at path "), F.col("path"))
    fresh = F.when(unmatched, F.raise_error(problem).cast("string")).otherwise(F.col("new_hash"))
    return conform(joined.withColumn("hash", fresh), ENTRIES)


# -- the merge -------------------------------------------------------------------


def _require_none(violations: DataFrame, what: str) -> None:
    row = violations.head()
    if row is not None:
        raise CatalogError(f"source {what}: {row.asDict()}")


def validated_digests(source: Catalog) -> DataFrame:
    """Digests and counters of complete source snapshots after all source checks passed."""
    check_schema_version(source.version)
    _require_none(validate.check_relationships(source), "relationships are broken")
    invalid = [
        df.select(F.lit(what).alias("what"), F.col("id").cast("string").alias("id"), "problem")
        for what, df in (
            ("drive is invalid", validate.validate_drives(source.drives)),
            ("snapshot is invalid", validate.validate_snapshots(source.snapshots)),
        )
    ]
    _require_none(invalid[0].unionAll(invalid[1]), "drive or snapshot")
    # The only pass over the source entries before they are copied.
    summary = cut_lineage(snapshot_summary(source))
    _require_none(summary.where(F.col("problem").isNotNull()).select("snapshot_id", "problem"), "entry is invalid")
    counted = summary.select("snapshot_id", F.col("files").alias("file_count"),
                             F.col("directories").alias("directory_count"), F.col("bytes").alias("total_bytes"))
    _require_none(validate.count_mismatches(source.snapshots, counted), "snapshot counts are wrong")
    return snapshot_digests(source.snapshots, summary)


def plan_merge(
    target: Catalog, source: Catalog, rename_conflicts: bool = False, trust: bool = False, now: int | None = None,
    dry_run: bool = False,
) -> MergePlan:
    """Validate ``source`` and work out its merge into ``target``."""
    now = int(time.time()) if now is None else now
    if source.location is not None and source.location == target.location:
        raise CatalogError("a catalog cannot be merged into itself")
    digests = validated_digests(source)
    drive_plan = cut_lineage(merge_drives(target.drives, source.drives, rename_conflicts))
    planned = cut_lineage(plan_import(digests, source.snapshots, target.imports, trust))
    mapped = cut_lineage(remap_snapshots(planned, next_snapshot_base(target.snapshots)))
    updates = planned.where(F.col("action") == "update")

    # Drives: new ones are added without a latest pointer, then pointers move.
    renamed = drive_plan.where(F.col("status") == "added").select("id", "target_name")
    added = source.drives.join(renamed, "id").withColumns({
        "name": F.col("target_name"), "latest_snapshot_id": F.lit(None).cast("long"),
    })
    latest = select_latest(target, mapped).withColumnRenamed("drive_id", "id").withColumnRenamed(
        "latest_snapshot_id", "moved_to"
    )
    drives = target.drives.unionByName(conform(added, DRIVES)).join(latest, "id", "left")
    drives = drives.withColumn("latest_snapshot_id", F.coalesce("moved_to", "latest_snapshot_id"))

    # Snapshots: imported rows, and the hash mode of flipped ones.
    imported = mapped.withColumns({
        "hash_mode": copied_mode(trust, F.col("full_hashes")), "id": F.col("target_id"), "status": F.lit("complete"),
    })
    flipped = updates.select(F.col("known_snapshot").alias("id"), copied_mode(trust, F.col("full_hashes")).alias("new_mode"))
    kept = target.snapshots.join(flipped, "id", "left").withColumn("hash_mode", F.coalesce("new_mode", "hash_mode"))
    snapshots = conform(kept, SNAPSHOTS).unionByName(conform(imported, SNAPSHOTS))

    # Receipts: new ones, and the policy of flipped ones.
    flips = updates.select("digest", F.lit(True).alias("flip"))
    stamp = F.lit(now).cast("long")
    receipts = target.imports.join(flips, "digest", "left").withColumns({
        "trusted_full_hashes": F.when(F.col("flip"), F.lit(trust)).otherwise(F.col("trusted_full_hashes")),
        "imported_at": F.when(F.col("flip"), stamp).otherwise(F.col("imported_at")),
    })
    new_receipts = mapped.select("digest", F.col("target_id").alias("target_snapshot_id"),
                                 F.lit(trust).alias("trusted_full_hashes"), stamp.alias("imported_at"))
    imports = conform(receipts, IMPORTS).unionByName(conform(new_receipts, IMPORTS))

    renames = drive_plan.where("renamed").select(
        F.col("id").alias("drive_id"), F.col("source_name").alias("from_name"), F.col("target_name").alias("to_name")
    )
    return MergePlan(
        drives=conform(drives, DRIVES),
        snapshots=snapshots,
        imports=imports,
        new_entries=copy_entries(source, mapped, trust),
        replaced_entries=apply_hash_policy(source, target, updates, trust),
        renames=renames,
        report=merge_report(drive_plan, planned, trust, source.version, source.location, dry_run),
    )


def merge_report(
    drive_plan: DataFrame, planned: DataFrame, trust: bool, version: int, location: str | None, dry_run: bool
) -> DataFrame:
    """One row of counters: what the merge adds, updates, skips and strips."""
    action = F.col("action")
    moved = action.isin("import", "update")
    hashes = F.coalesce(F.sum(F.when(moved, F.col("full_hashes"))), F.lit(0))
    zero = F.lit(0).cast("long")
    from_drives = drive_plan.agg(
        F.count_if(F.col("status") == "added").alias("drives_added"),
        F.count_if(F.col("status") == "merged").alias("drives_merged"),
        F.count_if("renamed").alias("drives_renamed"),
    )
    from_snapshots = planned.agg(
        F.count_if(action == "import").alias("snapshots_imported"),
        F.count_if(action == "update").alias("snapshots_updated"),
        F.count_if(action == "skip").alias("snapshots_skipped"),
        F.count_if(action == "incomplete").alias("incomplete_snapshots_skipped"),
        F.coalesce(F.sum(F.when(action == "import", F.col("rows"))), zero).alias("entries_imported"),
        (zero if trust else hashes).alias("full_hashes_stripped"),
        (hashes if trust else zero).alias("full_hashes_preserved"),
    )
    both = from_drives.unionByName(from_snapshots, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns]).select(
        F.lit(location).cast("string").alias("source"), F.lit(version).alias("source_schema_version"), "*",
        F.lit(dry_run).alias("dry_run"),
    )


def merge_catalog(
    target: CatalogStore, source: Catalog, rename_conflicts: bool = False, trust: bool = False, dry_run: bool = False,
    now: int | None = None,
) -> MergePlan:
    """Merge ``source`` into a stored catalog; all of it becomes visible at once, or nothing.

    A preview computes the same plan and report and publishes nothing; it does
    not create an absent target either.
    """
    if not dry_run:
        catalog = target.initialize()
    else:
        catalog = target.load() if target.exists() else _absent(target, source)
    plan = plan_merge(catalog, source, rename_conflicts, trust, now, dry_run)
    if dry_run:
        plan.replaced_entries.write.format("noop").mode("overwrite").save()
        return plan
    report = plan.report.head()
    if not (report["drives_added"] or report["snapshots_imported"] or report["snapshots_updated"]):
        return plan
    target.publish(
        {"drives": plan.drives, "snapshots": plan.snapshots, "imports": plan.imports},
        new_entries=plan.new_entries if report["snapshots_imported"] else None,
        replaced=plan.replaced_entries if report["snapshots_updated"] else None,
    )
    return plan


def _absent(target: CatalogStore, source: Catalog) -> Catalog:
    """An empty stand-in for a target that does not exist yet."""
    return Catalog(
        drives=source.drives.limit(0), snapshots=source.snapshots.limit(0), entries=source.entries.limit(0),
        imports=source.imports.limit(0), location=target.resolved_root(),
    )
