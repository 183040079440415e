from __future__ import annotations

import hashlib
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from archidex.functions.fingerprints import packed, unpacked
from archidex.operators import duplicates
from archidex.plans import derive
from archidex.schema import CatalogError
from archidex.session import CLEANUP_KEY
from archidex.sources.store import CatalogStore
from tests.conftest import catalog_of, entry, rows

ITEM = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp"


def day(n):
    return datetime(2024, 1, n)


@pytest.fixture(scope="module")
def items(spark):
    given = [
        (1, 1, 13, 4, 2.0, "A", day(1)), (1, 1, 13, 4, 2.0, "a", day(3)), (1, 1, 13, 4, 2.5, "A", day(2)),  # one path, two contents
        (11, 1, 13, 4, 2.0, "N", day(1)), (2, 2, 13, 5, 2.0, "R", day(4)), (3, 1, 14, 5, 2.0, "R", day(4)), (3, 1, 4109, 5, 2.0, "R", day(5)),
        # Names of joined numbers: missing ones leave no trace, so these two are one file, of which the old scan has one row.
        (None, 7, 20, 1, 1.0, "A", day(9)), (7, None, 20, 1, 1.0, "A", day(8)), (5, 1, 30, 1, None, "A", day(6)), (6, 1, 31, 1, 3.0, "A", None),
    ]
    return spark.createDataFrame(given, ITEM)


def expected(items):
    files = defaultdict(list)
    for r in items.collect():
        for v in (1, 2):
            if v == 2 or (r.l_orderkey is not None and r.l_orderkey % 11):
                quantity = None if r.l_quantity is None else int(r.l_quantity)
                names = [r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, quantity]
                path = f"Archive/part-{r.l_partkey % 4096}/" + "-".join(str(n) for n in names if n is not None) + "." + r.l_returnflag.lower()
                content = "-".join(str(n) for n in (r.l_partkey, r.l_quantity) if n is not None)
                size = r.l_partkey + 100 + (v == 1 and r.l_partkey % 13 == 0)
                files[v, path, size, "sha256:" + hashlib.sha256(content.encode()).hexdigest()].append(r.l_shipdate)
    return {k: max((d for d in dates if d), default=None) for k, dates in files.items()}


def test_order_files(items):
    got = derive.order_files(items).withColumn("modified_at", F.timestamp_seconds("modified_at")).collect()
    want = expected(items)
    assert len(got) == len(want)
    assert {(r.snapshot_id, r.path, r.size, r.hash): r.modified_at for r in got} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_files_are_grouped_once_by_short_columns(items):
    exchanges = [line for line in plan(derive.order_files(items)).splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hash#" not in exchanges[0] and "snapshot_id" not in exchanges[0]


HASHES = ["sha256:" + "0aF"[k % 2] * 64 for k in range(2)] + [
    "quick:" + "9b" * 32, "sha256:" + "AB" * 32, "SHA256:" + "ab" * 32, "sha256:" + "ab" * 32 + "\n", "sha256:", "", "é:1", "\0" + "a" * 32,
]


def test_fingerprints_as_bytes(spark):
    given = spark.createDataFrame([(h,) for h in [*HASHES, None]], "hash string").withColumn("bytes", packed(F.col("hash")))
    back = given.select("hash", "bytes", unpacked(F.col("bytes")).alias("back")).collect()
    assert [r.back for r in back] == [r.hash for r in back] == [*HASHES, None]
    assert len({bytes(r.bytes) for r in back[:-1]}) == len(HASHES)
    assert len(back[0].bytes) == 33


def test_duplicates_shuffle_bytes(spark):
    drive = {"id": "drv_000000000001", "name": "One", "latest_snapshot_id": 1}
    hashes = [h for h in HASHES if h.lower().startswith("sha256:")]
    files = [entry(1, f"{n}-{k}", 5, 1, h) for n in range(2) for k, h in enumerate(hashes)] + [entry(1, "alone", 6, 1, hashes[0])]
    catalog = catalog_of(spark, [drive], [{"id": 1, "drive_id": drive["id"]}], files)
    members = duplicates.duplicates_all(catalog)
    assert "hashpartitioning(content" in plan(members) and "hashpartitioning(hash" not in plan(members)
    assert sorted((r.hash, r.size, r.copies, r.path) for r in members.collect()) == sorted((f["hash"], 5, 2, f["path"]) for f in files[:-1])
    assert {r["hash"] for r in rows(duplicates.duplicate_groups_all(catalog))} == set(hashes)


def test_tables_from_stored_entries(spark, items, tmp_path):
    before = spark.conf.get(CLEANUP_KEY)
    whole = items.where("l_shipdate is not null and l_quantity <> 2.5")
    entries = derive.file_entries(derive.order_files(whole))
    seen = []

    def tables(stored):
        seen.extend(stored.inputFiles())
        return derive._two_scan_catalog(stored, derive.ORDER_DRIVES)

    catalog = CatalogStore(spark, str(tmp_path / "c"), index=False).publish(tables, new_entries=entries)
    plain = derive.order_catalog(whole)
    assert seen and all("entries/batch" in name for name in seen)
    assert sorted(map(tuple, catalog.snapshots.collect())) == sorted(map(tuple, plain.snapshots.collect()))
    assert sorted(map(tuple, catalog.drives.collect())) == sorted(map(tuple, plain.drives.collect()))
    assert sorted(map(tuple, catalog.entries.drop("id").collect())) == sorted(map(tuple, plain.entries.drop("id").collect()))
    assert spark.conf.get(CLEANUP_KEY) == before
    with pytest.raises(CatalogError):
        CatalogStore(spark, str(tmp_path / "d"), index=False).publish(tables)


def exchanges(df):
    return [line for line in plan(df).splitlines() if "Exchange" in line]


def whole(items):
    return items.where("l_shipdate is not null and l_quantity <> 2.5")


def test_laid_order_files_are_shuffled_once(spark, items, tmp_path):
    entries = derive.file_entries(derive.order_files(whole(items)))
    store = CatalogStore(spark, str(tmp_path / "c"), index=False)
    assert len(exchanges(store._checked(entries, 0, True))) == 1
    laid = store.publish(lambda stored: derive._two_scan_catalog(stored, derive.ORDER_DRIVES), new_entries=entries, laid=True)
    plain = derive.order_catalog(whole(items))
    assert sorted(map(tuple, laid.entries.drop("id").collect())) == sorted(map(tuple, plain.entries.drop("id").collect()))
    assert len({r.id for r in laid.entries.collect()}) == plain.entries.count()
    # A path with two contents is found out, also if the rows are not where they are said to be.
    scattered = spark.createDataFrame([entry(1, "a/x", 1), entry(1, "a/y", 1), entry(1, "a/x", 2)], laid.entries.schema).repartition(3, "size", "path")
    for broken in (derive.file_entries(derive.order_files(items.where("l_shipdate is not null"))), scattered):
        with pytest.raises(Exception, match="path listed twice"):
            store.publish(lambda stored: laid, new_entries=broken, laid=True)


def test_stored_names_are_the_ends_of_paths(spark, tmp_path):
    drive = {"id": "drv_000000000001", "name": "One", "latest_snapshot_id": 1}
    files = [entry(1, "a/b.txt", 5), entry(1, "c", 5), entry(1, "a/d", 5) | {"name": "other"}]
    catalog = catalog_of(spark, [drive], [{"id": 1, "drive_id": drive["id"]}], files)
    stored = CatalogStore(spark, str(tmp_path / "c")).publish(catalog, new_entries=catalog.entries)
    raw = spark.read.parquet(str(tmp_path / "c" / "entries"))
    assert {(r["path"], r["name"]) for r in raw.collect()} == {("a/b.txt", None), ("c", None), ("a/d", "other")}
    named = {("a/b.txt", "b.txt"), ("c", "c"), ("a/d", "other")}
    assert {(r["path"], r["name"]) for r in stored.entries.collect()} == named
    assert {r["name"] for r in stored.entries.select("name").collect()} == {n for _, n in named}
    assert {r["name"] for r in stored.postings.collect()} == {n for _, n in named}


def test_duplicates_in_slices(spark, tmp_path, monkeypatch):
    drives = [{"id": f"drv_00000000000{n}", "name": f"D{n}", "latest_snapshot_id": n} for n in (1, 2)]
    full = ["sha256:" + f"{k:064x}" for k in range(40)]
    files = [
        entry(n, f"{n}-{copy}-{k}", 5 + k % 3, 1, h) for n in (1, 2) for k, h in enumerate(full) for copy in range(k % 3 if n == 1 else k % 2)
    ]
    catalog = catalog_of(spark, drives, [{"id": n, "drive_id": drives[n - 1]["id"], "file_count": 60} for n in (1, 2)], files)
    catalog = CatalogStore(spark, str(tmp_path / "c"), index=False).publish(catalog, new_entries=catalog.entries)
    assert exchanges(duplicates.duplicates_all(catalog))
    kept, before = spark.conf.get(CLEANUP_KEY), {f.__name__: f(catalog) for f in (duplicates.duplicates_all, duplicates.duplicate_groups_all, duplicates.duplicate_groups)}
    page = duplicates.duplicate_groups(catalog, limit=7).collect()
    for name, value in (("SLICE_FILES", 1), ("GROUP_SLICES", 2), ("MEMBER_SLICES", 3)):
        monkeypatch.setattr(duplicates, name, value)
    for name, df in before.items():
        sliced = getattr(duplicates, name)(catalog)
        assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, df.collect())) != [] and sliced.dtypes == df.dtypes
        # What is shuffled for a slice is gone when the next begins; the results are read.
        assert not exchanges(sliced) and all("/duplicates-" in f for f in sliced.inputFiles())
    assert duplicates.duplicate_groups(catalog, limit=7).collect() == page and len(page) == 7
    assert spark.conf.get(CLEANUP_KEY) == kept
    one = duplicates.duplicates_all(catalog, drive_id=drives[0]["id"])
    assert {r["drive_id"] for r in one.collect()} == {drives[0]["id"]}
