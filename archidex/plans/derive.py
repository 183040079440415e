"""Catalogs derived from the given tables.

``documents`` gives one drive per source with an old and a new scan; pages and
parts give the multi-word paths for text search; ``lineitem`` gives a large
catalog with many real copies for timing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.functions.fingerprints import FULL, QUICK
from archidex.functions.paths import base_name, extension_of, is_hidden, parent_of
from archidex.operators.lifecycle import entry_counters
from archidex.schema import DRIVES, ENTRIES, IMPORTS, SNAPSHOTS, Catalog, conform, empty
from archidex.session import scratch_path
from archidex.sources.store import CatalogStore

EPOCH = 1_704_067_200
SCAN_EPOCH = 1_704_000_000
DAY = 86_400
# Line items that one task groups and sorts as files of two scans: some 1,100 bytes each in memory.
ITEMS_A_TASK = 200_000
# Fewer are not worth a task of their own.
LEAST_ITEMS = 20_000

_stores: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drive_id_of(key: Column) -> Column:
    return F.concat(F.lit("drv_"), F.left(F.sha2(key, 256), F.lit(12)))


def source_number(source: Column) -> Column:
    return F.substring(source, 4, 20).cast("int")


def _both_scans(df: DataFrame) -> DataFrame:
    """Every row once as seen by the old scan (v=1) and once by the new one (v=2)."""
    return df.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))


def document_files(documents: DataFrame) -> DataFrame:
    """File rows of the document archive: snapshot_id, drive_id, path, size, modified_at, hash."""
    doc, v, text = F.col("doc_id"), F.col("v"), F.col("text")
    suffix = (
        F.when(doc % 5 == 0, ".TXT").when(doc % 5 == 1, ".md").when(doc % 5 == 2, ".html").when(doc % 5 == 3, ".pdf")
        .otherwise("")
    )
    folder = F.concat(F.col("lang"), F.lit("/batch-"), (doc % 8).cast("string"))
    path = F.concat(folder, F.lit("/Doc_"), doc.cast("string"), suffix)
    new = v == 2
    content = (
        F.when(doc % 10 == 0, "")
        .when(doc % 10 == 1, F.concat(F.lit(QUICK), F.sha2(F.concat(F.lit("q"), text), 256)))
        .when(new & (doc % 19 == 0), F.concat(F.lit(FULL), F.sha2(F.concat(text, F.lit("!")), 256)))
        .otherwise(F.concat(F.lit(FULL), F.sha2(text, 256)))
    )
    # Disjoint classes: a document that the old scan lacks is in the new one, and the other way round.
    seen = ~((v == 1) & (doc % 13 == 5)) & ~((v == 2) & (doc % 11 == 3) & (doc % 13 != 5))
    return _both_scans(documents).where(seen).select(
        (source_number(F.col("source")) * 2 + v).cast("long").alias("snapshot_id"),
        drive_id_of(F.col("source")).alias("drive_id"),
        "source",
        path.alias("path"),
        (F.col("n_chars") + F.when(new & (doc % 7 == 0), 1).otherwise(0)).alias("size"),
        (F.lit(EPOCH) + doc * 60 + F.when(new & (doc % 17 == 0), 3600).otherwise(0)).alias("modified_at"),
        content.alias("hash"),
    )


def file_entries(files: DataFrame) -> DataFrame:
    name = base_name(F.col("path"))
    parent = F.col("parent_path") if "parent_path" in files.columns else parent_of(F.col("path"))
    return conform(
        files.select(
            "snapshot_id", "path", parent.alias("parent_path"), name.alias("name"),
            extension_of(name).alias("extension"), F.lit("file").alias("kind"), "size", "modified_at", "hash",
            is_hidden(name).alias("hidden"),
        ),
        ENTRIES,
    )


def folder_entries(files: DataFrame) -> DataFrame:
    """One directory entry for every folder above the files of a snapshot."""
    folders = files.select("snapshot_id", parent_of(F.col("path")).alias("path")).distinct()
    steps = F.sequence(F.lit(1), F.size(F.split("path", "/")))
    above = F.transform(steps, lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    each = folders.where(F.col("path") != "").select("snapshot_id", F.explode(above).alias("path")).distinct()
    name = base_name(F.col("path"))
    return conform(
        each.select(
            "snapshot_id", "path", parent_of(F.col("path")).alias("parent_path"), name.alias("name"),
            F.lit("").alias("extension"), F.lit("directory").alias("kind"), F.lit(0).alias("size"),
            F.lit(EPOCH).alias("modified_at"), F.lit("").alias("hash"), is_hidden(name).alias("hidden"),
        ),
        ENTRIES,
    )


def document_entries(documents: DataFrame) -> DataFrame:
    files = document_files(documents)
    return file_entries(files).unionByName(folder_entries(files))


def document_catalog(documents: DataFrame, entries: DataFrame | None = None) -> Catalog:
    """Drives, snapshots and entries of the document archive as lazy frames; entries as stored need not be made again."""
    entries = document_entries(documents) if entries is None else entries
    owners = documents.select("source").distinct().select(
        "source", source_number(F.col("source")).alias("n"), drive_id_of(F.col("source")).alias("drive_id")
    )
    scans = _both_scans(owners).withColumn("id", F.col("n") * 2 + F.col("v"))
    counted = entry_counters(entries).withColumnRenamed("snapshot_id", "id")
    started = F.lit(SCAN_EPOCH) + F.col("v") * DAY
    source_path = F.concat(F.lit("/mnt/"), F.col("source"))
    complete = scans.join(counted, "id").select(
        F.col("id").cast("long").alias("id"), "drive_id", source_path.alias("source_path"),
        F.lit("complete").alias("status"), F.lit("full").alias("hash_mode"),
        "file_count", "directory_count", "total_bytes", (F.col("n") % 3).alias("error_count"),
        started.alias("started_at"), (started + 60).alias("completed_at"), F.lit("").alias("failure"),
    )
    # Every fourth drive also has a failed scan, the next one a scan that never ended.
    unfinished = owners.where(F.col("n") % 4 < 2).select(
        (F.col("n") + 1_000_000).cast("long").alias("id"), "drive_id", source_path.alias("source_path"),
        F.when(F.col("n") % 4 == 0, "failed").otherwise("scanning").alias("status"), F.lit("full").alias("hash_mode"),
        F.lit(SCAN_EPOCH + 3 * DAY).alias("started_at"),
        F.when(F.col("n") % 4 == 0, SCAN_EPOCH + 3 * DAY + 60).alias("completed_at"),
        F.when(F.col("n") % 4 == 0, "device unplugged").otherwise("").alias("failure"),
    )
    zeros = {c: F.lit(0) for c in ("file_count", "directory_count", "total_bytes", "error_count")}
    snapshots = conform(complete, SNAPSHOTS).unionByName(conform(unfinished.withColumns(zeros), SNAPSHOTS))
    latest = complete.groupBy("drive_id").agg(F.max("id").alias("latest_snapshot_id"))
    drives = conform(
        owners.join(latest, "drive_id", "left").select(
            F.col("drive_id").alias("id"),
            F.concat(F.when(F.col("n") % 2 == 0, "Archive ").otherwise("archive "), F.col("source")).alias("name"),
            F.concat(F.lit("/mnt/"), F.col("source")).alias("source_path"),
            F.concat(F.lit("Shelf "), (F.col("n") % 3).cast("string")).alias("location"),
            F.lit("").alias("notes"),
            F.array(F.lit("text"), F.when(F.col("n") % 2 == 0, "even").otherwise("odd")).alias("tags"),
            F.lit("").alias("fingerprint"),
            "latest_snapshot_id",
            F.lit(SCAN_EPOCH).alias("created_at"),
            F.lit(SCAN_EPOCH + 2 * DAY + 60).alias("updated_at"),
        ),
        DRIVES,
    )
    return Catalog(drives, snapshots, entries, empty(documents.sparkSession, IMPORTS))


def library_files(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Web pages and parts as two drives with an old and a new scan each."""
    address = F.regexp_replace(F.regexp_replace(F.col("url"), "^https?://", ""), "/+$", "")
    page_files = _both_scans(pages).where((F.col("v") == 2) | (F.col("page_id") % 7 != 0)).select(
        F.col("v").cast("long").alias("snapshot_id"),
        F.concat(F.lit("web/p"), F.col("page_id").cast("string"), F.lit("/"), address).alias("path"),
        F.octet_length("html").cast("long").alias("size"),
        (F.lit(EPOCH) + F.col("page_id")).alias("modified_at"),
        F.concat(F.lit(FULL), F.sha2("html", 256)).alias("hash"),
    )
    key = F.col("p_partkey").cast("string")
    part_files = _both_scans(parts).where((F.col("v") == 2) | (F.col("p_partkey") % 5 != 0)).select(
        (F.col("v") + 2).cast("long").alias("snapshot_id"),
        F.concat(F.lit("parts/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), F.lower("p_type"),
                 F.lit("/"), F.col("p_name"), F.lit(" "), key, F.lit(".dat")).alias("path"),
        F.col("p_size").cast("long").alias("size"),
        (F.lit(EPOCH) + F.col("p_partkey")).alias("modified_at"),
        F.concat(F.lit(FULL), F.sha2("p_name", 256)).alias("hash"),
    )
    return page_files.unionByName(part_files)


def _two_scan_catalog(entries: DataFrame, names: list[str]) -> Catalog:
    """A catalog of ``entries`` whose snapshots 2i+1, 2i+2 belong to drive i of ``names``."""
    spark = entries.sparkSession
    owners = spark.createDataFrame(list(enumerate(names)), "n int, name string").withColumn("drive_id", drive_id_of(F.col("name")))
    counted = entry_counters(entries).withColumnRenamed("snapshot_id", "id")
    started = F.lit(SCAN_EPOCH) + F.col("v") * DAY
    snapshots = conform(
        _both_scans(owners).withColumn("id", (F.col("n") * 2 + F.col("v")).cast("long")).join(counted, "id").select(
            "id", "drive_id", F.lit("").alias("source_path"), F.lit("complete").alias("status"),
            F.lit("full").alias("hash_mode"), "file_count", "directory_count", "total_bytes",
            F.lit(0).alias("error_count"), started.alias("started_at"), (started + 60).alias("completed_at"),
            F.lit("").alias("failure"),
        ),
        SNAPSHOTS,
    )
    drives = conform(
        owners.select(
            F.col("drive_id").alias("id"), "name", F.lit("").alias("source_path"), F.lit("").alias("location"),
            F.lit("").alias("notes"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("fingerprint"),
            (F.col("n") * 2 + 2).alias("latest_snapshot_id"), F.lit(SCAN_EPOCH).alias("created_at"),
            F.lit(SCAN_EPOCH).alias("updated_at"),
        ),
        DRIVES,
    )
    return Catalog(drives, snapshots, entries, empty(spark, IMPORTS))


LIBRARY_DRIVES = ["Web pages", "Spare parts"]
ORDER_DRIVES = ["Orders"]


def library_catalog(pages: DataFrame, parts: DataFrame) -> Catalog:
    return _two_scan_catalog(file_entries(library_files(pages, parts)), LIBRARY_DRIVES)


def _tasks(items: DataFrame) -> int:
    """How many tasks group and sort that many line items: their number follows the items, and cores are used."""
    count = items.count()
    cores = items.sparkSession.sparkContext.defaultParallelism
    return max(-(-count // ITEMS_A_TASK), min(cores, -(-count // LEAST_ITEMS)), 1)


def order_files(lineitem: DataFrame) -> DataFrame:
    """One file per line item; copies share part and quantity. The old scan lacks some, differs in others.

    Files are in ranges of folders and paths, in which a store keeps them.
    """
    part = F.col("l_partkey")
    stem = F.concat(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), part.cast("string"),
                    F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string")),
        F.lit("."), F.lower("l_returnflag"),
    )
    path = F.concat(F.lit("Archive/part-"), (part % 4096).cast("string"), F.lit("/"), stem)
    # Only what files are made of is shuffled, once for grouping, both scans and the store's layout.
    short = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    items = short.repartitionByRange(_tasks(lineitem), parent_of(path), path).select(
        parent_of(path).alias("parent_path"), path.alias("path"), "l_partkey", F.col("l_quantity").cast("string").alias("quantity"),
        F.unix_timestamp("l_shipdate").alias("modified_at"), F.coalesce(F.col("l_orderkey") % 11 != 0, F.lit(False)).alias("in_old"),
    )
    # Line items can repeat in all that makes a file; a path names one file.
    once = items.groupBy("parent_path", "path", "l_partkey", "quantity").agg(
        F.max("in_old").alias("in_old"), F.max(F.when(F.col("in_old"), F.col("modified_at"))).alias("old_modified_at"),
        F.max("modified_at").alias("modified_at"),
    )
    old = F.col("v") == 1
    return _both_scans(once).where(~old | F.col("in_old")).select(
        F.col("v").cast("long").alias("snapshot_id"), "parent_path", "path",
        (part + 100 + F.when(old & (part % 13 == 0), 1).otherwise(0)).alias("size"),
        F.concat(F.lit(FULL), F.sha2(F.concat_ws("-", part.cast("string"), F.col("quantity")), 256)).alias("hash"),
        F.when(old, F.col("old_modified_at")).otherwise(F.col("modified_at")).alias("modified_at"),
    )


def order_catalog(lineitem: DataFrame) -> Catalog:
    return _two_scan_catalog(file_entries(order_files(lineitem)), ORDER_DRIVES)


def stored(spark: SparkSession, sf_dir: str, kind: str) -> Catalog:
    """The derived catalog as a published store in the shared folder, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _stores:
        if kind == "documents":
            documents = table(spark, sf_dir, "documents")
            entries, tables = document_entries(documents), lambda stored: document_catalog(documents, stored)
        elif kind == "library":
            entries = file_entries(library_files(table(spark, sf_dir, "pages"), table(spark, sf_dir, "part")))
            tables = lambda stored: _two_scan_catalog(stored, LIBRARY_DRIVES)
        else:
            entries = file_entries(order_files(table(spark, sf_dir, "lineitem")))
            tables = lambda stored: _two_scan_catalog(stored, ORDER_DRIVES)
        root = scratch_path(spark, f"catalog-{kind}")
        CatalogStore(spark, root, index=kind == "library").publish(tables, new_entries=entries, laid=kind == "orders")
        _stores[key] = root
    return CatalogStore(spark, _stores[key]).load()


# -- derived inputs of single operators -------------------------------------------


def file_list_rows(documents: DataFrame) -> DataFrame:
    """The document archive as file-list rows, in the mixed forms that lists come in."""
    doc = F.col("doc_id")
    moment = F.lit(EPOCH) + doc * 60
    stamp = F.timestamp_seconds(moment)
    folder = F.concat(F.lit("E:\\Archive\\"), F.col("source"), F.lit("\\"), F.col("lang"))
    time = (
        F.when(doc % 7 == 0, F.lit("unknown"))
        .when(doc % 6 == 0, (moment * 10_000_000 + F.lit(116_444_736_001_234_567)).cast("string"))
        .when(doc % 6 == 1, moment.cast("string"))
        .when(doc % 6 == 2, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(doc % 6 == 3, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
        .when(doc % 6 == 4, F.date_format(stamp, "M/d/yyyy h:mm a"))
        .otherwise(F.date_format(stamp, "dd/MM/yyyy HH:mm"))
    )
    size = (
        F.when(doc % 9 == 1, "n/a").when(doc % 9 == 2, "99999999999999999999")
        .otherwise(F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" ")))
    )
    files = documents.select(
        F.concat(folder, F.lit('\\Doc, "'), doc.cast("string"), F.lit('".TXT')).alias("Filename"),
        size.alias("Size"), time.alias("Date Modified"), F.lit("A").alias("Attributes"),
    )
    folders = documents.select(F.concat(folder, F.lit("\\")).alias("Filename")).distinct().select(
        "Filename", F.lit("").alias("Size"), F.lit("133801632000000000").alias("Date Modified"), F.lit("rd").alias("Attributes")
    )
    return files.unionByName(folders)


def written_file_lists(spark: SparkSession, sf_dir: str) -> list[str]:
    """The rows as lists with unlike columns; the second kind has a remark over two lines in every hundredth row."""
    path = scratch_path(spark, "file-list")
    rows = file_list_rows(table(spark, sf_dir, "documents"))
    first = F.pmod(F.xxhash64("Filename"), F.lit(2)) == 0
    remark = F.when(F.pmod(F.xxhash64("Filename"), F.lit(100)) == 1, "checked\ntwice").otherwise("")
    other = rows.where(~first).select("Attributes", "Size", remark.alias("Remark"), "Filename", "Date Modified")
    for name, part in (("a", rows.where(first)), ("b", other)):
        part.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{path}/{name}")
    return [f"{path}/a", f"{path}/b"]


def tree_paths(documents: DataFrame) -> DataFrame:
    """Path and text of every document as a file of a folder tree."""
    doc = F.col("doc_id")
    suffix = F.when(doc % 3 == 0, ".TXT").when(doc % 3 == 1, ".tar.gz").otherwise("")
    hidden = F.when(doc % 4 == 0, ".doc").otherwise("doc")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), hidden, F.lit("-"), doc.cast("string"), suffix)
    return documents.select(path.alias("path"), "text")


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as real files below a shared folder, written by the executors."""
    root = scratch_path(spark, "tree").removeprefix("file://").removeprefix("file:")

    def write(batches):
        import os

        import pandas as pd

        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as file:
                    file.write(text.encode("utf-8"))
            yield pd.DataFrame({"files": [len(batch)]})

    paths = tree_paths(table(spark, sf_dir, "documents"))
    paths.repartition(spark.sparkContext.defaultParallelism).mapInPandas(write, "files long").agg(F.sum("files")).collect()
    return root


def drive_number(snapshot_id: Column) -> Column:
    """The source number behind a snapshot id of the document archive."""
    return F.when(snapshot_id >= 1_000_000, snapshot_id - 1_000_000).otherwise(F.floor((snapshot_id - 1) / 2)).cast("int")


def merge_target(spark: SparkSession, sf_dir: str) -> Catalog:
    """The even drives of the document archive."""
    catalog = stored(spark, sf_dir, "documents")
    return _part(catalog, lambda n: n % 2 == 0)


def merge_source(spark: SparkSession, sf_dir: str) -> Catalog:
    """Odd drives, which are new to the target, and every third one, which is known to it in part.

    Some new drives carry names that differ from a target name in case only;
    scans of every twelfth drive are older than the target's.
    """
    catalog = _part(stored(spark, sf_dir, "documents"), lambda n: (n % 2 == 1) | (n % 3 == 0))
    n = F.regexp_extract("name", "src([0-9]+)$", 1).cast("int")
    clash = F.concat(F.lit("ARCHIVE SRC"), (n + 1).cast("string"))
    drives = catalog.drives.withColumn("name", F.when(n % 4 == 1, clash).otherwise(F.concat(F.lit("Other "), "name")))
    older = F.when(drive_number(F.col("id")) % 12 == 0, 10 * DAY).otherwise(0)
    snapshots = catalog.snapshots.withColumns({
        "started_at": F.col("started_at") - older, "completed_at": F.col("completed_at") - older,
    })
    return catalog.with_(drives=drives, snapshots=snapshots)


def _part(catalog: Catalog, chosen) -> Catalog:
    drives = catalog.drives.where(chosen(F.regexp_extract("name", "src([0-9]+)$", 1).cast("int")))
    snapshots = catalog.snapshots.where(chosen(drive_number(F.col("id"))))
    entries = catalog.entries.where(chosen(drive_number(F.col("snapshot_id"))))
    return catalog.with_(drives=drives, snapshots=snapshots, entries=entries, location=None)


def stored_target(spark: SparkSession, sf_dir: str) -> CatalogStore:
    """The merge target as a store of its own, new on every call."""
    target = merge_target(spark, sf_dir)
    store = CatalogStore(spark, scratch_path(spark, "merge-target"), index=False)
    store.publish(target, new_entries=target.entries)
    return store


def damaged_drives(drives: DataFrame) -> DataFrame:
    n = F.regexp_extract("name", "src([0-9]+)$", 1).cast("int")
    return drives.withColumns({
        "id": F.when(n % 5 == 0, F.upper("id")).otherwise(F.col("id")),
        "name": F.when(n % 5 == 1, " \t ").otherwise(F.col("name")),
        "notes": F.when(n % 5 == 2, "a\0b").otherwise(F.col("notes")),
        "tags": F.when(n % 5 == 3, F.array(F.lit("x\0"))).otherwise(F.col("tags")),
    })


def damaged_snapshots(snapshots: DataFrame) -> DataFrame:
    i = F.col("id")
    return snapshots.withColumns({
        "error_count": F.when(i % 6 == 0, -1).otherwise(F.col("error_count")).cast("long"),
        "completed_at": F.when(i % 6 == 1, F.col("started_at") - 1).when(i % 6 == 2, 0).otherwise(F.col("completed_at")).cast("long"),
        "hash_mode": F.when(i % 6 == 3, "weak").otherwise(F.col("hash_mode")),
        "source_path": F.when(i % 6 == 4, "/a\0").otherwise(F.col("source_path")),
    })


def damaged_entries(entries: DataFrame) -> DataFrame:
    """Entries of which most break one rule, chosen by size so that every rule is met."""
    k = F.col("size") % 13
    path = F.col("path")
    return entries.withColumns({
        "path": F.when(k == 1, F.concat(F.lit("/"), path)).when(k == 2, F.concat(path, F.lit("/")))
        .when(k == 3, F.concat(F.lit("a\\"), path)).when(k == 4, F.concat(F.lit("../"), path))
        .when(k == 5, F.concat(F.lit("x//"), path)).otherwise(path),
        "name": F.when(k == 6, F.lit("other")).otherwise(F.col("name")),
        "parent_path": F.when(k == 7, F.lit("other")).otherwise(F.col("parent_path")),
        "extension": F.when(k == 8, F.lit("a/b")).otherwise(F.col("extension")),
        "hash": F.when(k == 9, F.upper(F.concat(F.lit("md5:"), "hash"))).otherwise(F.col("hash")),
        "kind": F.when(k == 10, F.lit("socket")).otherwise(F.col("kind")),
        "hidden": F.when(k == 11, F.lit(None)).otherwise(F.col("hidden")),
        "size": F.when(k == 12, -F.col("size")).otherwise(F.col("size")),
    })
