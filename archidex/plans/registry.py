"""Every operator as a query over the given tables."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archidex.functions import display, fingerprints, paths, tags
from archidex.operators import (
    browse, diff, digest, drives, duplicates, export, folders, impact, lifecycle, merge, search, stats, validate,
)
from archidex.plans import derive
from archidex.schema import DRIVES, ENTRIES, IMPORTS, SNAPSHOTS, Catalog, CatalogError, empty
from archidex.session import scratch_path
from archidex.sources.filelist import read_file_list
from archidex.sources.globs import exclude_globs
from archidex.sources.inventory import file_inventory, inventory_entries
from archidex.sources.staged import reading_report, staged_duplicates, staged_fingerprints
from archidex.sources.store import CatalogStore

Query = Callable[[SparkSession, str], DataFrame]

NOW = 1_704_400_000
EXPORTED = (
    "name", "source_path", "location", "notes", "fingerprint", "latest_snapshot_id", "created_at", "updated_at", "last_scanned_at",
    "drive_id", "status", "hash_mode", "file_count", "directory_count", "total_bytes", "error_count", "started_at", "completed_at",
    "failure", "snapshot_id", "path", "parent_path", "extension", "kind", "size", "modified_at", "hash", "hidden",
)
EXCLUDED = ("*.md", "fr/**", "batch-[0-2]", "en/batch-7/Doc_?.TXT", "[bad")
SEARCH_TEXT = "blue gear"
SEARCH_WHOLE = "brand"
SEARCH_TEXTS = (
    "blue gear", "small", "en example.com", '"brand-2"', "red -", "'brand-1' wid", "promo/hot", "page 2 ref", "absentword",
)
_ENTRY = ("snapshot_id", "path", "parent_path", "name", "extension", "kind", "size", "modified_at", "hash", "hidden")


def _documents(spark: SparkSession, sf_dir: str) -> Catalog:
    return derive.stored(spark, sf_dir, "documents")


def _library(spark: SparkSession, sf_dir: str) -> Catalog:
    return derive.stored(spark, sf_dir, "library")


def _source_id(catalog: Catalog, name: str) -> str:
    return drives.resolve_drive(catalog, name).head()["id"]


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(*(empty(spark, schema) for schema in (DRIVES, SNAPSHOTS, ENTRIES, IMPORTS)))


def _flat_drives(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", "|"))


# -- sources and sinks -------------------------------------------------------------


def read_efu(spark, sf_dir):
    return read_file_list(spark, derive.written_file_lists(spark, sf_dir), strip_prefix="E:\\Archive").drop("origin")


def read_catalog(spark, sf_dir):
    return _documents(spark, sf_dir).entries.select(*_ENTRY)


def inventory(spark, sf_dir):
    root = derive.written_tree(spark, sf_dir)
    return inventory_entries(file_inventory(spark, root, hash_mode="full", folders_per_task=8)).drop("modified_at")


def staged(spark, sf_dir):
    files = staged_fingerprints(spark, derive.written_tree(spark, sf_dir))
    return files.select("path", "size", "stage", "hash", "bytes_read")


def staged_groups(spark, sf_dir):
    return staged_duplicates(staged_fingerprints(spark, derive.written_tree(spark, sf_dir)))


def staged_reading(spark, sf_dir):
    return reading_report(staged_fingerprints(spark, derive.written_tree(spark, sf_dir)))


def excluded(spark, sf_dir):
    current = _documents(spark, sf_dir).current_entries("path", "kind")
    return exclude_globs(current, EXCLUDED).select("drive_id", "path", "kind")


def fingerprint_full(spark, sf_dir):
    text = F.col("text").cast("binary")
    return derive.table(spark, sf_dir, "documents").select("doc_id", fingerprints.full_fingerprint(text).alias("hash"))


def fingerprint_quick(spark, sf_dir):
    content = F.repeat("text", 6).cast("binary")
    return derive.table(spark, sf_dir, "documents").select("doc_id", fingerprints.quick_fingerprint(content).alias("hash"))


def export_csv(spark, sf_dir):
    return export.export_rows(_documents(spark, sf_dir))


def export_json(spark, sf_dir):
    lines = export.export_json_lines(_documents(spark, sf_dir))
    fields = [F.get_json_object("line", f"$.body.{f}").alias(f"body_{f}") for f in EXPORTED]
    return lines.select("drive_id", "section", "place", *fields)


def export_document(spark, sf_dir):
    """The lines of the nested document, each without the comma before it, as JSON fields."""
    lines = export.export_document_lines(_documents(spark, sf_dir), exported_at=NOW)
    text = F.regexp_replace("line", "^,", "")
    item = (F.col("section") % 2 == 1) & (F.col("part") == 1)
    body = F.when(item, text).when((F.col("section") == 0) & (F.col("part") == 1), F.concat(text, F.lit("]}")))
    fields = [F.get_json_object(body, f"$.{f}").alias(f"body_{f}") for f in ("name", "path", "status", "size", "modified_at")]
    edge = F.when(~item & (F.col("section") > 0) | (F.col("part") != 1), F.col("line")).alias("edge")
    # The item that follows the opening of its list has no comma.
    first = F.count_if(item & ~F.startswith("line", F.lit(","))).over(Window.partitionBy("drive_id", "section")).alias("firsts")
    return lines.select("part", "drive_id", "section", "place", *fields, edge, first)


# -- column expressions --------------------------------------------------------------


def path_columns(spark, sf_dir):
    pages = derive.table(spark, sf_dir, "pages")
    raw = F.concat(F.lit(" \\"), F.replace("url", F.lit("/"), F.lit("\\")), F.lit("/\t"))
    path = paths.catalog_path(raw)
    name = paths.base_name(path)
    return pages.select(
        "page_id", path.alias("path"), paths.parent_of(path).alias("parent_path"), name.alias("name"),
        paths.extension_of(name).alias("extension"), paths.nocase(F.upper(path)).alias("name_key"),
        paths.is_hidden(name).alias("hidden"),
    )


def tag_lists(spark, sf_dir):
    text = F.concat_ws(",", F.lit("  "), F.concat(F.lit(" "), "lang"), F.upper("lang"), F.col("source"), F.lit(""), F.concat("source", F.lit(" ")))
    return derive.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tags.normalize_tags(tags.split_tags(text)), "|").alias("tags")
    )


def display_text(spark, sf_dir):
    size = F.col("n_chars") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 7919).otherwise(15_485_863)
    return derive.table(spark, sf_dir, "documents").select(
        "doc_id", display.human_bytes(size).alias("bytes_text"), display.human_count(size).alias("count_text"),
        display.shorten(F.col("text"), 12).alias("short_text"),
    )


# -- lifecycle ------------------------------------------------------------------------


def _committed(spark: SparkSession, sf_dir: str) -> CatalogStore:
    """Drives created and one finished scan each committed into a new store."""
    derived = _documents(spark, sf_dir)
    store = CatalogStore(spark, scratch_path(spark, "commit"), index=False)
    empty = store.initialize()
    new_drives = derived.drives.select("id", "name", "location", "tags")
    store.publish(empty.with_(drives=lifecycle.create_drives(empty.drives, new_drives, NOW - 100)))
    headers = derived.current_drives().select(
        F.col("latest_snapshot_id").alias("scan_key"), F.col("id").alias("drive_id"),
        F.concat(F.lit("/media/"), "name").alias("source_path"), F.lit("full").alias("hash_mode"),
        F.lit(1).alias("error_count"), F.lit(NOW - 60).alias("started_at"),
    )
    scanned = derived.current_entries().withColumn("scan_key", F.col("snapshot_id")).drop("id", "snapshot_id")
    store.commit_snapshots(headers, scanned, NOW)
    return store


def _latest_scans(catalog: Catalog) -> DataFrame:
    scans = catalog.snapshots.withColumnRenamed("id", "snapshot_id").drop("source_path")
    found = catalog.drives.select("id", "name", "source_path", "latest_snapshot_id", "updated_at")
    return scans.join(found, scans["drive_id"] == found["id"]).select(
        "name", "source_path", "snapshot_id", "status", "file_count", "directory_count", "total_bytes", "error_count",
        "started_at", "completed_at", "updated_at", "failure",
        (F.col("snapshot_id") == F.col("latest_snapshot_id")).alias("is_latest"),
    )


def commit_snapshot(spark, sf_dir):
    return _latest_scans(_committed(spark, sf_dir).load())


def fail_snapshot(spark, sf_dir):
    store = _committed(spark, sf_dir)
    headers = store.load().drives.select(
        F.col("id").alias("scan_key"), F.col("id").alias("drive_id"), F.lit("/media/x").alias("source_path"),
        F.lit("quick").alias("hash_mode"), F.lit(NOW).alias("started_at"),
    )
    return _latest_scans(store.fail_snapshots(headers, "device unplugged", NOW + 5))


def start_snapshot(spark, sf_dir):
    store = _committed(spark, sf_dir)
    headers = store.load().drives.select(
        F.col("id").alias("scan_key"), F.col("id").alias("drive_id"), F.lit("/media/x").alias("source_path"),
        F.lit("quick").alias("hash_mode"), F.lit(NOW + 2).alias("started_at"),
    )
    return _latest_scans(store.start_snapshots(headers)[0])


def commit_rejections(spark, sf_dir):
    """Three commits, each of a third of the drives and each with one kind of damage in its entries."""
    derived = _documents(spark, sf_dir)
    store = CatalogStore(spark, scratch_path(spark, "rejections"), index=False)
    empty = store.initialize()
    new_drives = derived.drives.select("id", "name")
    store.publish(empty.with_(drives=lifecycle.create_drives(empty.drives, new_drives, NOW - 100)))
    n = F.regexp_extract("name", "src([0-9]+)$", 1).cast("int")
    numbers = derived.drives.select(F.col("id").alias("drive_id"), n.alias("n"))
    scanned = derived.current_entries().join(numbers, "drive_id").drop("id", "snapshot_id")
    damages = (
        lambda e: e.unionAll(e),
        lambda e: e.withColumn("scan_key", F.concat(F.col("scan_key"), F.lit("?"))),
        lambda e: e.withColumn("kind", F.lit("socket")),
    )
    for third, damage in enumerate(damages):
        headers = numbers.where(F.col("n") % 3 == third).select(
            F.col("drive_id").alias("scan_key"), "drive_id", F.lit("/media/x").alias("source_path"),
            F.lit("none").alias("hash_mode"), F.lit(0).alias("error_count"), F.lit(NOW - 60).alias("started_at"),
        )
        try:
            store.commit_snapshots(headers, damage(scanned.where(F.col("n") % 3 == third).withColumn("scan_key", F.col("drive_id"))), NOW)
        except Exception as error:  # noqa: BLE001 - any refusal counts; what is stored afterwards is the result
            logging.getLogger(__name__).info("refused: %s", error)
    catalog = store.load()
    reason = F.regexp_extract("failure", "(unknown scan|unknown kind|listed twice)", 1)
    kept = catalog.entries.groupBy(F.col("snapshot_id").alias("id")).count()
    latest = catalog.drives.select(F.col("id").alias("drive_id"), "name", "latest_snapshot_id")
    return catalog.snapshots.join(kept, "id", "left").join(latest, "drive_id").select(
        "name", "status", reason.alias("reason"), F.coalesce("count", F.lit(0)).alias("entries"), "file_count", "started_at",
        "completed_at", F.col("latest_snapshot_id").isNotNull().alias("has_latest"),
    )


def check_schema_version(spark, sf_dir):
    """Which of four catalogs of the same drives, of versions 0 to 3, can be opened, and how many drives each then shows."""
    derived = _documents(spark, sf_dir)
    shown = None
    for version in range(4):
        store = CatalogStore(spark, scratch_path(spark, "versions"), index=False)
        try:
            opened = store.publish(empty_catalog(spark).with_(drives=derived.drives), schema_version=version).drives
        except CatalogError:
            opened = None
        drives = derived.drives.limit(0) if opened is None else opened
        part = drives.agg(F.count("*").alias("drives")).select(
            F.lit(version).alias("version"), F.lit(opened is not None).alias("accepted"), "drives"
        )
        shown = part if shown is None else shown.unionAll(part)
    return shown


def recover_stale(spark, sf_dir):
    return lifecycle.recover_stale(_documents(spark, sf_dir).snapshots, NOW)


def create_drive(spark, sf_dir):
    known = _documents(spark, sf_dir).drives
    new = derive.table(spark, sf_dir, "supplier").select(
        derive.drive_id_of(F.col("s_name")).alias("id"), F.concat(F.lit("  "), "s_name", F.lit("\t")).alias("name"),
        F.concat(F.lit(" Nation "), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("location"),
        F.array(F.lit("Tape"), F.lit(" tape"), F.col("s_name"), F.lit("")).alias("tags"),
    )
    return _flat_drives(lifecycle.create_drives(known, new, NOW))


def update_drive(spark, sf_dir):
    known = _documents(spark, sf_dir).drives
    n = F.regexp_extract("name", "src([0-9]+)$", 1).cast("int")
    patches = known.where(n % 4 > 0).select(
        "id",
        F.when(n % 4 == 1, F.concat(F.lit(" Renamed "), "name", F.lit(" "))).alias("name"),
        F.when(n % 4 == 2, F.lit(" moved ")).alias("location"),
        F.when(n % 4 == 3, F.array(F.lit(" New"), F.lit("new "), F.lit("b"))).alias("tags"),
    )
    return _flat_drives(lifecycle.update_drives(known, patches, NOW))


# -- reads ------------------------------------------------------------------------------


def list_drives(spark, sf_dir):
    return _flat_drives(drives.list_drives(_documents(spark, sf_dir)))


def resolve_drive(spark, sf_dir):
    return _flat_drives(drives.resolve_drive(_documents(spark, sf_dir), "ARCHIVE SRC3"))


def recent_drives(spark, sf_dir):
    return drives.recent_drives(_documents(spark, sf_dir)).select("id", "name", "last_scanned_at")


def snapshot_history(spark, sf_dir):
    return browse.snapshot_history(_documents(spark, sf_dir))


def get_snapshot(spark, sf_dir):
    return browse.get_snapshot(_documents(spark, sf_dir), 4)


def list_entries(spark, sf_dir):
    return browse.list_entries(_documents(spark, sf_dir), 4, " \\en\\ ", limit=6, offset=1).select(*_ENTRY)


def list_latest_entries(spark, sf_dir):
    catalog = _documents(spark, sf_dir)
    return browse.list_latest_entries(catalog, _source_id(catalog, "archive src1")).select(*_ENTRY)


def snapshot_entries(spark, sf_dir):
    return browse.snapshot_entries(_documents(spark, sf_dir), 3).select(*_ENTRY)


def breadcrumbs(spark, sf_dir):
    current = _documents(spark, sf_dir).current_entries("path").select("drive_id", "drive_name", "path")
    return browse.breadcrumbs(current, F.col("drive_name")).drop("drive_name")


def search_query(spark, sf_dir):
    hits = search.search_scan(_library(spark, sf_dir), SEARCH_TEXT)
    return _ranked(hits)


def search_index(spark, sf_dir):
    return _ranked(search.search(_library(spark, sf_dir), SEARCH_TEXT))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("path", "size", "drive_id", "drive_name", F.round("score", 6).alias("score"))


def search_batch(spark, sf_dir):
    hits = search.search_batch(_library(spark, sf_dir), SEARCH_TEXTS, limit=25)
    return hits.select("query", "path", F.round("score", 6).alias("score"))


def search_topk(spark, sf_dir):
    catalog = _library(spark, sf_dir)
    index = impact.build(catalog, scratch_path(spark, "impact"))
    return _ranked(impact.search_topk(catalog, index, SEARCH_WHOLE, limit=40))


def search_all(spark, sf_dir):
    return _ranked(search.search_all(_library(spark, sf_dir), SEARCH_WHOLE))


def search_index_all(spark, sf_dir):
    return _ranked(search.search_index_all(_library(spark, sf_dir), SEARCH_WHOLE))


def catalog_stats(spark, sf_dir):
    return stats.stats(_documents(spark, sf_dir))


def extension_stats(spark, sf_dir):
    return stats.extension_stats(_documents(spark, sf_dir))


def extension_stats_drive(spark, sf_dir):
    catalog = _documents(spark, sf_dir)
    return stats.extension_stats(catalog, _source_id(catalog, "Archive src4"), limit=3)


def diff_two(spark, sf_dir):
    catalog = _documents(spark, sf_dir)
    return diff.diff(catalog, _source_id(catalog, "archive src1"), 3, 4)


def extension_stats_all(spark, sf_dir):
    return stats.extension_stats_all(_documents(spark, sf_dir))


def diff_all(spark, sf_dir):
    return diff.diff_all(_documents(spark, sf_dir), 3, 4)


def folder_digests(spark, sf_dir):
    return folders.folder_digests(_documents(spark, sf_dir).entries)


def diff_descent(spark, sf_dir):
    return folders.diff_by_descent(_documents(spark, sf_dir), 3, 4)


def diff_latest_two(spark, sf_dir):
    return diff.diff_latest_two(_documents(spark, sf_dir))


def duplicate_files(spark, sf_dir):
    return duplicates.duplicates(_documents(spark, sf_dir))


def duplicates_all(spark, sf_dir):
    return duplicates.duplicates_all(_documents(spark, sf_dir))


def duplicates_orders_all(spark, sf_dir):
    return duplicates.duplicates_all(derive.stored(spark, sf_dir, "orders"))


def duplicate_files_drive(spark, sf_dir):
    catalog = _documents(spark, sf_dir)
    return duplicates.duplicates(catalog, _source_id(catalog, "Archive src8"), limit=200)


def duplicate_files_orders(spark, sf_dir):
    return duplicates.duplicates(derive.stored(spark, sf_dir, "orders"), limit=200)


def duplicates_nested(spark, sf_dir):
    groups = duplicates.duplicates_nested(_documents(spark, sf_dir), chunk_files=2)
    return groups.select("hash", "size", "copies", F.explode("files").alias("file")).select("hash", "size", "copies", "file.*")


# -- merge ---------------------------------------------------------------------------------


def check_relationships(spark, sf_dir):
    catalog = _documents(spark, sf_dir)
    n = F.regexp_extract("name", "src([0-9]+)$", 1).cast("int")
    return validate.check_relationships(
        catalog.with_(snapshots=catalog.snapshots.where(F.col("id") % 9 > 0), drives=catalog.drives.where(n % 7 > 0))
    )


def validate_drives(spark, sf_dir):
    return validate.validate_drives(derive.damaged_drives(_documents(spark, sf_dir).drives))


def validate_snapshots(spark, sf_dir):
    return validate.validate_snapshots(derive.damaged_snapshots(_documents(spark, sf_dir).snapshots))


def validate_entries(spark, sf_dir):
    return validate.validate_entries(derive.damaged_entries(_documents(spark, sf_dir).entries))


def reconcile_counts(spark, sf_dir):
    catalog = _documents(spark, sf_dir)
    off = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    wrong = catalog.snapshots.withColumns({"file_count": F.col("file_count") + off, "total_bytes": F.col("total_bytes") - off})
    return validate.reconcile_counts(catalog.with_(snapshots=wrong)).withColumn("bytes", F.col("bytes").cast("long"))


def snapshot_digest(spark, sf_dir):
    source = derive.merge_source(spark, sf_dir)
    digests = digest.snapshot_digests(source.snapshots, digest.snapshot_summary(source))
    return digests.select("id", "drive_id", "rows", "files", "directories", "full_hashes", "body_digest", "digest")


def merge_drives(spark, sf_dir):
    target, source = derive.merge_target(spark, sf_dir), derive.merge_source(spark, sf_dir)
    return merge.merge_drives(target.drives, source.drives, rename_conflicts=True)


def _planned(spark, sf_dir):
    """Source snapshots planned against a target that knows every third of them."""
    source = derive.merge_source(spark, sf_dir)
    digests = merge.validated_digests(source)
    receipts = digests.where(F.col("id") % 3 == 0).select(
        "digest", F.col("id").alias("target_snapshot_id"), (F.col("id") % 2 == 0).alias("trusted_full_hashes"),
        F.lit(NOW).alias("imported_at"),
    )
    return merge.plan_import(digests, source.snapshots, receipts, trust=True)


def plan_import(spark, sf_dir):
    return _planned(spark, sf_dir).select("id", "drive_id", "status", "digest", "known_snapshot", "action")


def remap_snapshots(spark, sf_dir):
    target = derive.merge_target(spark, sf_dir)
    base = lifecycle.next_snapshot_base(target.snapshots)
    return merge.remap_snapshots(_planned(spark, sf_dir), base).select("id", "drive_id", "target_id")


def _merge_anew(spark: SparkSession, sf_dir: str) -> tuple[CatalogStore, merge.MergePlan]:
    store = derive.stored_target(spark, sf_dir)
    plan = merge.merge_catalog(store, derive.merge_source(spark, sf_dir), rename_conflicts=True, now=NOW)
    return store, plan


_merges: dict[tuple[str, str], tuple[CatalogStore, merge.MergePlan]] = {}


def _merged(spark: SparkSession, sf_dir: str) -> tuple[CatalogStore, merge.MergePlan]:
    """A finished merge that the queries which only read its outcome share."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _merges:
        _merges[key] = _merge_anew(spark, sf_dir)
    return _merges[key]


def copy_entries(spark, sf_dir):
    store, _ = _merged(spark, sf_dir)
    return store.load().entries.select(*_ENTRY)


def compact_catalog(spark, sf_dir):
    store, _ = _merged(spark, sf_dir)
    return store.compact().entries.select(*_ENTRY)


def apply_hash_policy(spark, sf_dir):
    store, _ = _merge_anew(spark, sf_dir)
    merge.merge_catalog(store, derive.merge_source(spark, sf_dir), rename_conflicts=True, trust=True, now=NOW + 1)
    return store.load().entries.select(*_ENTRY)


def select_latest(spark, sf_dir):
    store, _ = _merged(spark, sf_dir)
    return store.load().drives.select("id", "name", "latest_snapshot_id")


def merged_snapshots(spark, sf_dir):
    store, _ = _merged(spark, sf_dir)
    return store.load().snapshots


def import_receipts(spark, sf_dir):
    store, _ = _merged(spark, sf_dir)
    return store.load().imports


def import_report(spark, sf_dir):
    _, plan = _merged(spark, sf_dir)
    return plan.report.drop("source")


def merge_dry_run(spark, sf_dir):
    store, _ = _merged(spark, sf_dir)
    source = derive.merge_source(spark, sf_dir)
    return merge.merge_catalog(store, source, rename_conflicts=True, trust=True, dry_run=True, now=NOW).report.drop("source")


QUERIES: dict[str, Query] = {
    "read_efu": read_efu,
    "read_catalog": read_catalog,
    "file_inventory": inventory,
    "exclude_globs": excluded,
    "staged_fingerprints": staged,
    "staged_duplicates": staged_groups,
    "staged_reading": staged_reading,
    "fingerprint_full": fingerprint_full,
    "fingerprint_quick": fingerprint_quick,
    "export_csv": export_csv,
    "export_json": export_json,
    "export_document": export_document,
    "path_columns": path_columns,
    "tag_lists": tag_lists,
    "display_text": display_text,
    "commit_snapshot": commit_snapshot,
    "fail_snapshot": fail_snapshot,
    "start_snapshot": start_snapshot,
    "commit_rejections": commit_rejections,
    "check_schema_version": check_schema_version,
    "recover_stale": recover_stale,
    "create_drive": create_drive,
    "update_drive": update_drive,
    "list_drives": list_drives,
    "resolve_drive": resolve_drive,
    "recent_drives": recent_drives,
    "snapshot_history": snapshot_history,
    "get_snapshot": get_snapshot,
    "list_entries": list_entries,
    "list_latest_entries": list_latest_entries,
    "snapshot_entries": snapshot_entries,
    "breadcrumbs": breadcrumbs,
    "search": search_query,
    "search_index": search_index,
    "search_batch": search_batch,
    "search_topk": search_topk,
    "search_all": search_all,
    "search_index_all": search_index_all,
    "stats": catalog_stats,
    "extension_stats": extension_stats,
    "extension_stats_drive": extension_stats_drive,
    "extension_stats_all": extension_stats_all,
    "diff": diff_two,
    "diff_all": diff_all,
    "diff_latest_two": diff_latest_two,
    "diff_descent": diff_descent,
    "folder_digests": folder_digests,
    "duplicates": duplicate_files,
    "duplicates_all": duplicates_all,
    "duplicates_orders_all": duplicates_orders_all,
    "duplicates_drive": duplicate_files_drive,
    "duplicates_orders": duplicate_files_orders,
    "duplicates_nested": duplicates_nested,
    "check_relationships": check_relationships,
    "validate_drives": validate_drives,
    "validate_snapshots": validate_snapshots,
    "validate_entries": validate_entries,
    "reconcile_counts": reconcile_counts,
    "snapshot_digest": snapshot_digest,
    "merge_drives": merge_drives,
    "plan_import": plan_import,
    "remap_snapshots": remap_snapshots,
    "copy_entries": copy_entries,
    "compact_catalog": compact_catalog,
    "apply_hash_policy": apply_hash_policy,
    "select_latest": select_latest,
    "merged_snapshots": merged_snapshots,
    "import_receipts": import_receipts,
    "import_report": import_report,
    "merge_dry_run": merge_dry_run,
}
