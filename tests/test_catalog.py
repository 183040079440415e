from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from archidex.operators import browse, diff, drives, duplicates, export, lifecycle, stats
from archidex.operators.search import search
from archidex.schema import CatalogError
from archidex.sources.store import CatalogStore, Manifest, check_schema_version
from tests.conftest import catalog_of, entry, rows

TAPE = "drv_0000000000b1"


def scan(spark, drive_id, entries, key="s"):
    headers = spark.createDataFrame(
        [(key, drive_id, "/mnt/tapes", "full", 0, 50)],
        "scan_key string, drive_id string, source_path string, hash_mode string, error_count long, started_at long",
    )
    data = spark.createDataFrame([{**e, "scan_key": key} for e in entries]).drop("snapshot_id")
    return headers, data


@pytest.fixture
def store(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "catalog"))
    catalog = store.initialize()
    new = spark.createDataFrame(
        [(TAPE, "\tField tapes ", "Vault 7", ["sound", " SOUND", "raw  "])], "id string, name string, location string, tags array<string>"
    )
    store.publish(catalog.with_(drives=lifecycle.create_drives(catalog.drives, new, 10)))
    return store


def test_lifecycle(spark, store, tmp_path):
    kept, dropped = "sha256:" + "1" * 64, "sha256:" + "2" * 64
    before = [entry(0, "reels", kind="directory"), entry(0, "reels/wind.wav", 700, 11, kept), entry(0, "notes.txt", 5, 12, dropped)]
    after = [entry(0, "reels", kind="directory"), entry(0, "reels/wind.wav", 700, 11, kept), entry(0, "reels/rain storm.wav", 900, 13)]
    store.commit_snapshots(*scan(spark, TAPE, before), now=5000)
    catalog = store.commit_snapshots(*scan(spark, TAPE, after), now=6000)

    shown = rows(drives.list_drives(catalog))
    assert [(d["name"], d["tags"], d["file_count"], d["total_bytes"], d["last_scanned_at"]) for d in shown] == [
        ("Field tapes", ["sound", "raw"], 2, 1600, 6000)
    ]
    assert shown[0]["source_path"] == "/mnt/tapes" and shown[0]["updated_at"] == 6000
    assert [r["path"] for r in rows(search(catalog, "storm rai"))] == ["reels/rain storm.wav"]
    assert [r["name"] for r in rows(browse.list_latest_entries(catalog, TAPE, "/reels/"))] == ["rain storm.wav", "wind.wav"]
    changes = rows(diff.diff(catalog, TAPE, 1, 2))
    assert [(c["change"], c["path"]) for c in changes] == [("removed", "notes.txt"), ("added", "reels/rain storm.wav")]
    assert rows(stats.stats(catalog)) == [{
        "drive_count": 1, "snapshot_count": 2, "file_count": 2, "directory_count": 1, "total_bytes": 1600, "hashed_file_count": 1,
    }]
    assert [s["id"] for s in rows(browse.snapshot_history(catalog, TAPE))] == [2, 1]
    ids = [r["id"] for r in rows(catalog.entries)]
    assert len(set(ids)) == len(ids) == 6

    patch = spark.createDataFrame([(TAPE, " Moved ", ["x", "X"])], "id string, name string, tags array<string>")
    catalog = store.publish(catalog.with_(drives=lifecycle.update_drives(catalog.drives, patch, 7000)))
    found = rows(drives.resolve_drive(catalog, "MOVED"))[0]
    assert (found["tags"], found["location"], found["updated_at"]) == (["x"], "Vault 7", 7000)

    export.write_csv(catalog, str(tmp_path / "csv"))
    lines = [line for p in sorted((tmp_path / "csv").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == ",".join(export.CSV_COLUMNS) and len(set(lines)) == 4
    export.write_json_document(catalog, str(tmp_path / "json"), exported_at=1704067200)
    text = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    document = json.loads(text)
    assert document["version"] == 1 and document["exported_at"] == "2024-01-01T00:00:00Z"
    drive = document["drives"][0]
    assert [s["id"] for s in drive["snapshots"]] == [2, 1] and "failure" not in drive["snapshots"][0]
    assert [e["path"] for e in drive["latest_entries"]] == ["reels", "reels/rain storm.wav", "reels/wind.wav"]
    assert drive["latest_entries"][0]["modified_at"] == "0001-01-01T00:00:00Z" and "hash" not in drive["latest_entries"][0]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_exported_times_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = spark.sql("select explode(array(1704067200L, 1L, -1L, 951827696L)) as s").select(export.utc_text(F.col("s"), False).alias("t"))
        assert [r.t for r in texts.collect()] == [
            "2024-01-01T00:00:00Z", "1970-01-01T00:00:01Z", "1969-12-31T23:59:59Z", "2000-02-29T12:34:56Z",
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_failed_scan_is_never_latest(spark, store):
    store.commit_snapshots(*scan(spark, TAPE, [entry(0, "a", 1)]), now=1000)
    headers, _ = scan(spark, TAPE, [entry(0, "b", 1)])
    catalog = store.fail_snapshots(headers, "unplugged", now=1500)
    assert rows(catalog.drives)[0]["latest_snapshot_id"] == 1
    failed = rows(browse.get_snapshot(catalog, 2))[0]
    assert (failed["status"], failed["failure"], failed["completed_at"]) == ("failed", "unplugged", 1500)
    assert catalog.entries.count() == 1
    with pytest.raises(CatalogError, match="complete"):
        diff.diff(catalog, TAPE, 1, 2)


def test_refused_commits_leave_a_failed_scan_and_no_entries(spark, store):
    store.commit_snapshots(*scan(spark, TAPE, [entry(0, "a", 1)]), now=1000)
    good = [entry(0, "d/b", 1), entry(0, "c", 1)]
    cases = [
        ("listed twice", scan(spark, TAPE, [*good, entry(0, "d/b", 2)])),
        ("unknown kind", scan(spark, TAPE, [*good, entry(0, "s", kind="socket")])),
        ("unknown scan", (scan(spark, TAPE, good)[0], scan(spark, TAPE, good, key="other")[1])),
        ("missing value", (scan(spark, TAPE, good)[0], scan(spark, TAPE, good)[1].withColumn("size", F.lit(None).cast("long")))),
    ]
    for number, (reason, (headers, data)) in enumerate(cases, start=2):
        with pytest.raises(Exception, match=reason):
            store.commit_snapshots(headers, data, now=2000)
        catalog = store.load()
        failed = rows(browse.get_snapshot(catalog, number))[0]
        assert failed["status"] == "failed" and reason in failed["failure"] and failed["completed_at"] == 2000
        assert catalog.entries.count() == 1 and rows(catalog.drives)[0]["latest_snapshot_id"] == 1


def test_started_scan_is_recorded(spark, store):
    catalog, _ = store.start_snapshots(scan(spark, TAPE, [entry(0, "a")])[0])
    assert [(s["status"], s["completed_at"]) for s in rows(catalog.snapshots)] == [("scanning", None)]


def test_commit_evaluates_its_input_once(spark, store):
    headers, data = scan(spark, TAPE, [entry(0, f"p{i}", 1) for i in range(10)])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    store.commit_snapshots(headers, data.mapInPandas(count, data.schema), now=1000)
    assert seen.value == 10


def test_compaction_and_expiry_keep_every_row(spark, store, tmp_path):
    for n in range(3):
        store.commit_snapshots(*scan(spark, TAPE, [entry(0, f"f{n}", n), entry(0, "all words", 1)]), now=1000 + n)
    before = sorted(map(str, rows(store.load().entries)))
    hits = rows(search(store.load(), "words"))
    catalog = store.compact()
    assert len(store.manifest().batches) == 1 and sorted(map(str, rows(catalog.entries))) == before
    deleted = store.expire()
    assert any(p.startswith("entries/batch=") for p in deleted) and "manifests/v00000001.json" in deleted
    catalog = store.load()
    assert sorted(map(str, rows(catalog.entries))) == before and rows(search(catalog, "words")) == hits
    assert store.expire() == []
    store.commit_snapshots(*scan(spark, TAPE, [entry(0, "later", 9)]), now=2000)
    ids = [r["id"] for r in rows(store.load().entries)]
    assert len(set(ids)) == len(ids) == len(before) + 1


def test_unknown_drive(spark, store):
    with pytest.raises(CatalogError, match="unknown drive"):
        store.commit_snapshots(*scan(spark, "drv_ffffffffffff", [entry(0, "a")]))


def test_stale_scans_fail(spark, tmp_path):
    catalog = catalog_of(
        spark, [{"id": TAPE, "name": "B"}],
        [{"id": 1, "drive_id": TAPE, "status": "scanning", "started_at": 10, "completed_at": None},
         {"id": 2, "drive_id": TAPE, "status": "scanning", "started_at": 100_000, "completed_at": None}], [],
    )
    found = rows(lifecycle.recover_stale(catalog.snapshots, 100_500).orderBy("id"))
    assert [(s["status"], s["completed_at"]) for s in found] == [("failed", 100_500), ("scanning", None)]
    assert found[0]["failure"] == "scan interrupted before completion"


def test_drive_rules(spark, store):
    known = store.load().drives
    for name, message in ((" ", "blank"), ("FIELD tapes", "stand for 2")):
        with pytest.raises(CatalogError, match=message):
            lifecycle.create_drives(known, spark.createDataFrame([(name,)], "name string"), 1)
    made = rows(lifecycle.create_drives(known, spark.createDataFrame([("É",), ("é",)], "name string"), 1))
    assert len({d["id"] for d in made}) == 3 and all(d["id"].startswith("drv_") and len(d["id"]) == 16 for d in made)
    for patch, message in (((TAPE, " "), "blank"), (("drv_x", "n"), "unknown drive")):
        with pytest.raises(CatalogError, match=message):
            lifecycle.update_drives(known, spark.createDataFrame([patch], "id string, name string"), 1)


def test_repeated_drive_ids_and_patches_are_refused(spark, store):
    known = store.load().drives
    twice = spark.createDataFrame([("drv_0000000000c1", "x"), ("drv_0000000000c1", "y")], "id string, name string")
    with pytest.raises(CatalogError, match="two drives"):
        lifecycle.create_drives(known, twice, 1)
    with pytest.raises(CatalogError, match="2 patches"):
        lifecycle.update_drives(known, spark.createDataFrame([(TAPE, "x"), (TAPE, "y")], "id string, name string"), 1)


def test_resolve_prefers_the_id(spark):
    catalog = catalog_of(spark, [{"id": "drv_2", "name": "drv_1"}, {"id": "drv_1", "name": "Other"}], [], [])
    assert rows(drives.resolve_drive(catalog, "drv_1"))[0]["name"] == "Other"
    assert rows(drives.resolve_drive(catalog, "OTHER"))[0]["id"] == "drv_1"
    assert rows(drives.resolve_drive(catalog, "none")) == []


def test_duplicates_need_full_hashes(spark):
    hashes = ["sha256:one", "sha256:one", "quick:two", "quick:two"]
    names = [f"drv_{i}" for i in range(4)]
    catalog = catalog_of(
        spark, [{"id": d, "name": d, "latest_snapshot_id": i + 1} for i, d in enumerate(names)],
        [{"id": i + 1, "drive_id": d} for i, d in enumerate(names)],
        [entry(i + 1, "dump/image.raw", 9000, 1, h) for i, h in enumerate(hashes)],
    )
    assert [(r["drive_id"], r["copies"]) for r in rows(duplicates.duplicates(catalog))] == [("drv_0", 2), ("drv_1", 2)]
    nested = rows(duplicates.duplicates_nested(catalog))
    assert [f["drive_id"] for f in nested[0]["files"]] == ["drv_0", "drv_1"] and len(nested) == 1
    assert rows(duplicates.duplicates(catalog, drive_id="drv_0")) == []


def test_hot_duplicate_group_and_huge_sizes(spark):
    entries = [entry(1, f"p{i:03d}", 2**62, 1, "sha256:hot") for i in range(60)]
    entries += [entry(1, "q1", 5, 1, "SHA256:x"), entry(1, "q2", 5, 1, "SHA256:x"), entry(1, "z", 5)]
    catalog = catalog_of(spark, [{"id": "d", "name": "d", "latest_snapshot_id": 1}], [{"id": 1, "drive_id": "d", "total_bytes": 0}], entries)
    groups = rows(duplicates.duplicate_groups(catalog))
    assert [(g["hash"], g["copies"]) for g in groups] == [("sha256:hot", 60), ("SHA256:x", 2)]
    nested = duplicates.duplicates_nested(catalog, chunk_files=20)
    paths = [f["path"] for r in rows(nested.where("hash = 'sha256:hot'")) for f in r["files"]]
    assert nested.where("hash = 'sha256:hot'").count() == 3 and sorted(paths) == [f"p{i:03d}" for i in range(60)]


@pytest.fixture(scope="module")
def pair(spark):
    old = [entry(1, "still", 8, 30, "sha256:c"), entry(1, "gone", 1, 1), entry(1, "Kind", 1, 1),
           entry(1, "quick", 1, 1, "quick:a"), entry(1, "full", 1, 1, "sha256:a"), entry(1, "time", 1, 1), entry(1, "size", 1, 1)]
    new = [entry(2, "still", 8, 30, "quick:d"), entry(2, "new", 2, 2), entry(2, "Kind", 1, 1, kind="directory"),
           entry(2, "quick", 1, 1, "quick:b"), entry(2, "full", 1, 1, "sha256:b"), entry(2, "time", 1, 2), entry(2, "size", 2, 1)]
    return catalog_of(
        spark, [{"id": "d", "name": "d", "latest_snapshot_id": 2}],
        [{"id": 1, "drive_id": "d"}, {"id": 2, "drive_id": "d", "completed_at": 120}], old + new,
    )


def test_diff_rules(pair):
    found = {c["path"]: c for c in rows(diff.diff(pair, "d", 1, 2))}
    assert {p: c["change"] for p, c in found.items()} == {
        "gone": "removed", "new": "added", "Kind": "changed", "quick": "changed", "full": "changed", "time": "changed", "size": "changed",
    }
    assert list(found) == ["full", "gone", "Kind", "new", "quick", "size", "time"]
    assert found["Kind"]["kind"] == "directory" and found["gone"]["new_size"] is None and found["size"]["new_size"] == 2


def test_diff_laws(pair):
    assert rows(diff.diff(pair, "d", 1, 1)) == []
    there = rows(diff.diff_all(pair, 1, 2))
    back = rows(diff.diff_all(pair, 2, 1))
    mirror = {"removed": "added", "added": "removed", "changed": "changed"}
    assert {(mirror[c["change"]], c["path"], c["new_size"], c["old_size"]) for c in there} == {
        (c["change"], c["path"], c["old_size"], c["new_size"]) for c in back
    }
    latest = rows(diff.diff_latest_two(pair))
    assert {(c["change"], c["path"]) for c in latest} == {(c["change"], c["path"]) for c in there}
    with pytest.raises(CatalogError):
        diff.diff(pair, "other", 1, 2)
    assert len(rows(diff.diff(pair, "d", 1, 2, limit=2))) == 2
    with pytest.warns(UserWarning, match="5001"):
        assert len(rows(diff.diff(pair, "d", 1, 2, limit=5001))) == 7


def test_page_order_and_limits(spark):
    entries = [entry(1, f"d/{n}") for n in ("b", "A", "c")] + [entry(1, "d/z", kind="directory"), entry(1, "d", kind="directory")]
    catalog = catalog_of(spark, [{"id": "d", "name": "d", "latest_snapshot_id": 1}], [{"id": 1, "drive_id": "d"}], entries)
    assert [r["name"] for r in rows(browse.list_entries(catalog, 1, "d"))] == ["z", "A", "b", "c"]
    assert [r["name"] for r in rows(browse.list_entries(catalog, 1, "d", limit=2, offset=1))] == ["A", "b"]
    with pytest.warns(UserWarning, match="limit 0"):
        assert len(rows(browse.list_entries(catalog, 1, "d", limit=0))) == 4
    crumbs = browse.breadcrumbs(catalog.entries.where("path = 'd/A'").select("path"), F.lit("Root"))
    assert [(c["label"], c["crumb_path"]) for c in rows(crumbs.orderBy("depth"))] == [("Root", ""), ("d", "d"), ("A", "d/A")]


def test_extension_label_collision(spark):
    entries = [entry(1, "a", 5), entry(1, "b.(none)", 7), entry(1, "d.x", kind="directory")]
    catalog = catalog_of(spark, [{"id": "d", "name": "d", "latest_snapshot_id": 1}], [{"id": 1, "drive_id": "d"}], entries)
    assert rows(stats.extension_stats(catalog)) == [
        {"extension": "(none)", "count": 1, "bytes": 7}, {"extension": "(none)", "count": 1, "bytes": 5},
    ]


def test_stats_of_an_empty_catalog(spark, tmp_path):
    catalog = CatalogStore(spark, str(tmp_path / "none")).initialize()
    assert set(rows(stats.stats(catalog))[0].values()) == {0}
    assert rows(drives.list_drives(catalog)) == []


@pytest.mark.parametrize("version", ["0", "x", "", "-1", "1.5", 3])
def test_schema_versions_rejected(version):
    with pytest.raises(CatalogError):
        check_schema_version(version)


def test_future_catalog_is_left_alone(spark, store, tmp_path):
    assert check_schema_version("1") == 1
    current = store.manifest()
    future = Manifest(**{**current.__dict__, "version": current.version + 1, "schema_version": 99})
    store._publish(future)
    with pytest.raises(CatalogError, match="newer"):
        store.initialize()
    assert store.manifest() == future


def test_folder_page_reads_one_partition(spark, store):
    store.commit_snapshots(*scan(spark, TAPE, [entry(0, "a", 1)]), now=1000)
    plan = browse.list_entries(store.load(), 1, "x")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan and "EqualTo(parent_path,x)" in plan


def test_current_view_prunes_partitions_at_run_time(spark, store):
    store.commit_snapshots(*scan(spark, TAPE, [entry(0, "a", 1)]), now=1000)
    plan = stats.extension_stats(store.load())._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan
