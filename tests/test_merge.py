from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from archidex.operators import lifecycle, merge, validate
from archidex.operators.digest import snapshot_digests, snapshot_summary
from archidex.schema import CatalogError
from archidex.sources.store import CatalogStore
from tests.conftest import catalog_of, entry, rows

A, B = "drv_0000000000a1", "drv_0000000000b2"
FULL, OTHER, QUICK = "sha256:" + "a" * 64, "sha256:" + "b" * 64, "quick:" + "c" * 64


def source_catalog(spark, name="Laptop", drive=A, **snapshot):
    entries = [entry(s, p, 10, 50, h) for s in (1, 2, 3) for p, h in (("d/x.bin", FULL), ("d/y.bin", QUICK))]
    return catalog_of(
        spark, [{"id": drive, "name": name, "tags": ["t"], "latest_snapshot_id": 2}],
        [{"id": 1, "drive_id": drive, **snapshot}, {"id": 2, "drive_id": drive, "completed_at": 210},
         {"id": 3, "drive_id": drive, "status": "failed", "completed_at": 300}],
        entries, location="file:/source",
    )


@pytest.fixture
def target(spark, tmp_path):
    return CatalogStore(spark, str(tmp_path / "target"), index=False)


def report(plan):
    keep = rows(plan.report)[0]
    return {k: v for k, v in keep.items() if k not in ("source", "source_schema_version", "dry_run") and v}


def hashes(store):
    return {(r["snapshot_id"], r["path"]): r["hash"] for r in rows(store.load().entries)}


def test_merge_preview_merge_and_repeat(spark, target):
    source = source_catalog(spark)
    expected = {
        "drives_added": 1, "snapshots_imported": 2, "incomplete_snapshots_skipped": 1, "entries_imported": 4, "full_hashes_stripped": 2,
    }
    preview = merge.merge_catalog(target, source, dry_run=True)
    assert report(preview) == expected and not target.exists()
    assert rows(preview.report)[0]["dry_run"] and rows(preview.report)[0]["source"] == "file:/source"

    assert report(merge.merge_catalog(target, source, now=999)) == expected
    catalog = target.load()
    assert rows(catalog.drives)[0]["latest_snapshot_id"] == 2 and rows(catalog.drives)[0]["tags"] == ["t"]
    assert {s["hash_mode"] for s in rows(catalog.snapshots)} == {"imported"}
    assert sorted(hashes(target).values()) == ["", "", QUICK, QUICK]
    assert {(r["target_snapshot_id"], r["trusted_full_hashes"], r["imported_at"]) for r in rows(catalog.imports)} == {
        (1, False, 999), (2, False, 999)
    }
    before = target.load()
    again = merge.merge_catalog(target, source)
    assert report(again) == {"drives_merged": 1, "snapshots_skipped": 2, "incomplete_snapshots_skipped": 1}
    for table in ("drives", "snapshots", "entries", "imports"):
        assert sorted(map(repr, rows(getattr(target.load(), table)))) == sorted(map(repr, rows(getattr(before, table))))


def test_trust_flips_both_ways(spark, target):
    source = source_catalog(spark)
    merge.merge_catalog(target, source, trust=True)
    kept = hashes(target)
    ids = {(r["snapshot_id"], r["path"]): r["id"] for r in rows(target.load().entries)}
    assert sorted(set(kept.values())) == [QUICK, FULL]
    assert {s["hash_mode"] for s in rows(target.load().snapshots)} == {"full"}
    flipped = merge.merge_catalog(target, source, trust=False, now=5)
    assert report(flipped)["snapshots_updated"] == 2 and report(flipped)["full_hashes_stripped"] == 2
    assert sorted(set(hashes(target).values())) == ["", QUICK]
    assert {s["hash_mode"] for s in rows(target.load().snapshots)} == {"imported"}
    assert {(r["trusted_full_hashes"], r["imported_at"]) for r in rows(target.load().imports)} == {(False, 5)}
    restored = merge.merge_catalog(target, source, trust=True)
    assert report(restored)["full_hashes_preserved"] == 2 and hashes(target) == kept
    assert {(r["snapshot_id"], r["path"]): r["id"] for r in rows(target.load().entries)} == ids
    assert {s["hash_mode"] for s in rows(target.load().snapshots)} == {"full"}


def test_flip_needs_the_same_paths(spark, target):
    source = source_catalog(spark)
    merge.merge_catalog(target, source)
    catalog = target.load()
    target.publish(catalog, replaced=catalog.entries.where("snapshot_id = 1 and path <> 'd/y.bin'"))
    version = target.manifest().version
    with pytest.raises(Exception, match="differ at path"):
        merge.merge_catalog(target, source, trust=True)
    assert target.manifest().version == version


def test_replaced_snapshots_are_a_table_and_not_part_of_the_plan(spark, tmp_path):
    """Flip after flip the entries stay right, and reading them takes the same plan."""
    drive = {"id": A, "name": "Many", "latest_snapshot_id": 40}
    whole = catalog_of(
        spark, [drive], [{"id": i, "drive_id": A} for i in range(1, 41)], [entry(i, f"d/{i}.bin", size=i) for i in range(1, 41)]
    )
    store = CatalogStore(spark, str(tmp_path / "flips"))
    catalog = store.publish(whole, new_entries=whole.entries)
    sizes = []
    for flip, upto in enumerate((40, 25, 40, 1), start=1):
        changed = catalog.entries.where(f"snapshot_id <= {upto}").withColumn("hash", F.lit(f"quick:{flip}"))
        catalog = store.publish(catalog, replaced=changed)
        assert store.manifest().superseded_rows == sum((40, 25, 40, 1)[:flip])
        sizes.append(catalog.entries._jdf.queryExecution().optimizedPlan().toString().count("snapshot_id"))
        found = {r.snapshot_id: r.hash for r in catalog.entries.collect()}
        assert len(found) == catalog.entries.count() == 40
    assert found == {1: "quick:4", **{i: "quick:3" for i in range(2, 41)}}
    assert len(set(sizes)) == 1
    plan = catalog.entries._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "InSet" not in plan
    assert store.compact().entries.count() == 40 and store.manifest().superseded_rows == 0
    assert any(p.startswith("superseded/") for p in store.expire())
    assert {r.hash for r in store.load().entries.collect()} == {"quick:3", "quick:4"}


def test_unreadable_version_is_never_published(spark, target):
    target.initialize()
    before = target.manifest()
    with pytest.raises(CatalogError, match="newer"):
        target.publish(target.load(), schema_version=9)
    assert target.manifest() == before and target.load().drives.count() >= 0


def test_name_conflict(spark, target):
    empty = target.initialize()
    local = spark.createDataFrame([(B, "LAPTOP")], "id string, name string")
    target.publish(empty.with_(drives=lifecycle.create_drives(empty.drives, local, 1)))
    source = source_catalog(spark)
    with pytest.raises(CatalogError, match="already belongs"):
        merge.merge_catalog(target, source)
    plan = merge.merge_catalog(target, source, rename_conflicts=True)
    assert rows(plan.renames) == [{"drive_id": A, "from_name": "Laptop", "to_name": "Laptop (imported 0000a1)"}]
    assert {d["name"] for d in rows(target.load().drives)} == {"LAPTOP", "Laptop (imported 0000a1)"}


def sequential_names(target, source):
    """Names as adding the drives one by one in id order gives them."""
    taken = {n.lower() for _, n in target}
    result, begin = {}, {}  # names are never given back, so a mark's search goes on where its last one ended
    for drive, name in sorted(d for d in source if d[0] not in {t for t, _ in target}):
        candidate, attempt = name, 0
        mark = f"{name} (imported {drive[-6:]})".lower()
        while candidate.lower() in taken:
            attempt = max(attempt + 1, begin.get(mark, 1))
            candidate = f"{name} (imported {drive[-6:]})" + (f" {attempt}" if attempt > 1 else "")
        begin[mark] = attempt
        taken.add(candidate.lower())
        result[drive] = candidate
    return result


def test_chained_renames_equal_one_by_one(spark):
    ids = [f"drv_0000000000{i:02x}" for i in range(8)]
    target = [("drv_f00000000000", "A"), ("drv_f00000000001", "a (imported 000001)"), ("drv_f00000000002", "B"), (ids[7], "Known")]
    source = [
        (ids[1], "a"), (ids[2], "A (imported 000001) 2"), (ids[0], "C"), (ids[3], "b"), (ids[4], "B (imported 000003)"),
        (ids[5], "D"), (ids[7], "a"),
    ]
    frames = [spark.createDataFrame(t, "id string, name string") for t in (target, source)]
    plan = {r["id"]: r for r in rows(merge.merge_drives(*frames, rename_conflicts=True))}
    expected = sequential_names(target, source)
    assert {i: r["target_name"] for i, r in plan.items() if r["status"] == "added"} == expected
    assert plan[ids[7]]["status"] == "merged" and plan[ids[7]]["target_name"] == "Known"
    assert plan[ids[1]]["target_name"] == "a (imported 000001) 2" and plan[ids[2]]["renamed"]


def assigned(spark, target, source):
    schema = "id string, name string"
    plan = rows(merge.merge_drives(spark.createDataFrame(target, schema), spark.createDataFrame(source, schema), rename_conflicts=True))
    return {r["id"]: r["target_name"] for r in plan if r["status"] == "added"}


def test_ten_thousand_clashing_drives_equal_one_by_one(spark):
    """One series of marked names; some of its places belong to the target, to earlier and to later drives."""
    target = [("drv_ffffff000000", "Box")] + [(f"drv_ffffff{i:06x}", f"BOX (imported 00aaaa) {i}") for i in (2, 3, 700)]
    source = [(f"drv_{i:06x}00aaaa", "box" if i % 2 else "BOX") for i in range(1, 9_800)]
    source += [("drv_000000bbbbbb", "Box (imported 00aaaa) 5"), ("drv_000abcbbbbbb", "box (Imported 00aaaa) 4000")]
    assert assigned(spark, target, source) == sequential_names(target, source)


@pytest.mark.parametrize("seed", range(4))
def test_names_that_cross_series_equal_one_by_one(spark, seed):
    draw = random.Random(seed)
    ends = ["00000a", "00000b"]
    bases = ["x", "X", *[f"x (imported {e})" for e in ends], *[f"X (imported {e}) {n}" for e in ends for n in (2, 3, 4, 9)],
             "x (imported 00000a) 02", "x (imported 00000a) 1", "x (imported 00000a) 2\n", "x (imported 00000a) (imported 00000b)"]
    source = [(f"drv_{i:06x}{draw.choice(ends)}", draw.choice(bases)) for i in draw.sample(range(1000), 60)]
    names = draw.sample(bases, 5)
    target = [(f"drv_ffffff{i:06x}", n) for i, n in enumerate({n.lower(): n for n in names}.values())]
    assert assigned(spark, target, source) == sequential_names(target, source)


def test_no_name_left_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(merge, "MAX_NAME_ATTEMPTS", 20)
    source = [(f"drv_{i:06x}00aaaa", "box") for i in range(30)]
    with pytest.raises(CatalogError, match="no free name"):
        assigned(spark, [("drv_ffffff000000", "box")], source)


def rejected(target, source, message):
    target.initialize()
    before = target.manifest()
    with pytest.raises(CatalogError, match=message):
        merge.merge_catalog(target, source)
    assert target.manifest() == before


def test_damaged_sources_are_rejected(spark, target):
    target.initialize()
    rejected(target, source_catalog(spark, file_count=3), "counts are wrong")
    rejected(target, source_catalog(spark).with_(version=99), "newer")
    rejected(target, source_catalog(spark, hash_mode="weak"), "snapshot is invalid")
    rejected(target, source_catalog(spark, drive="drv_X"), "drive is invalid")
    good = source_catalog(spark)
    rejected(target, good.with_(drives=good.drives.where("false")), "relationships")
    bad = good.entries.withColumn("name", F.when(F.col("id") == 1, "z").otherwise(F.col("name")))
    rejected(target, good.with_(entries=bad), "inconsistent name")


def test_self_import_is_rejected(spark, target):
    with pytest.raises(CatalogError, match="into itself"):
        merge.merge_catalog(target, target.initialize())


def test_byte_totals_beyond_a_long(spark):
    entries = [entry(1, "a", 2**63 - 1), entry(1, "b", 2**63 - 1)]
    catalog = catalog_of(
        spark, [{"id": A, "name": "a"}], [{"id": 1, "drive_id": A, "file_count": 2, "total_bytes": -2}], entries
    )
    assert [r["problem"] for r in rows(validate.reconcile_counts(catalog))] == ["too many bytes for a counter"]


def test_version_one_source_without_receipts(spark, target):
    source = catalog_of(
        spark, [{"id": "drv_010203040506", "name": "Legacy", "latest_snapshot_id": 1}],
        [{"id": 1, "drive_id": "drv_010203040506", "hash_mode": "none"}], [entry(1, "legacy.txt", 3, 9)], version=1,
    )
    plan = merge.merge_catalog(target, source)
    assert report(plan)["snapshots_imported"] == 1 and rows(plan.report)[0]["source_schema_version"] == 1
    assert {s["hash_mode"] for s in rows(target.load().snapshots)} == {"none"}


def test_latest_follows_completion_time(spark, target):
    merge.merge_catalog(target, source_catalog(spark))
    catalog = target.load()
    local = spark.createDataFrame([("k", A, "/m", "none", 0, 150)],
                                  "scan_key string, drive_id string, source_path string, hash_mode string, error_count long, started_at long")
    scanned = spark.createDataFrame([{**entry(0, "d/local", 1), "scan_key": "k"}]).drop("snapshot_id")
    target.commit_snapshots(local, scanned, now=1000)
    older = catalog_of(
        spark, [{"id": A, "name": "Other"}],
        [{"id": 7, "drive_id": A, "completed_at": 110}, {"id": 8, "drive_id": A, "completed_at": 999}], [entry(7, "a"), entry(8, "b")],
    )
    merge.merge_catalog(target, older)
    assert rows(target.load().drives)[0]["latest_snapshot_id"] == 3
    tied = catalog_of(
        spark, [{"id": A, "name": "Other"}],
        [{"id": 9, "drive_id": A, "completed_at": 1000}, {"id": 10, "drive_id": A, "completed_at": 1000}], [entry(9, "a"), entry(10, "a")],
    )
    merge.merge_catalog(target, tied)
    assert rows(target.load().drives)[0]["latest_snapshot_id"] == 7
    assert rows(target.load().drives)[0]["name"] == "Laptop"


def test_identical_scans_stay_distinct(spark):
    catalog = source_catalog(spark)
    digests = rows(snapshot_digests(catalog.snapshots, snapshot_summary(catalog)))
    assert len({d["digest"] for d in digests}) == 2 and len({d["body_digest"] for d in digests}) == 1


def test_digest_sees_every_field_and_no_order(spark):
    base = source_catalog(spark)

    def body(catalog):
        return {r["snapshot_id"]: r["body_digest"] for r in rows(snapshot_summary(catalog))}[1]

    first = body(base)
    assert body(base.with_(entries=base.entries.orderBy(F.col("path").desc()).repartition(3))) == first
    for column, value in (("size", 11), ("modified_at", 51), ("hash", OTHER), ("hidden", True), ("kind", "symlink"), ("extension", "BIN")):
        changed = base.entries.withColumn(column, F.when(F.col("id") == 1, F.lit(value)).otherwise(F.col(column)))
        assert body(base.with_(entries=changed)) != first, column


def test_digest_needs_neither_order_nor_counters(spark):
    """Symlinks alone are in no counter; rows in any order and layout give one digest, any other rows another."""
    entries = [entry(1, f"links/{i:05d}", i, kind="symlink") for i in range(3000)]
    catalog = catalog_of(spark, [{"id": A, "name": "a"}], [{"id": 1, "drive_id": A, "file_count": 77}], entries)
    seen = set()
    for order in (catalog.entries, catalog.entries.repartition(7, "path"), catalog.entries.orderBy(F.col("path").desc())):
        found = rows(snapshot_summary(catalog.with_(entries=order)))[0]
        assert (found["rows"], found["files"], found["directories"], found["problem"]) == (3000, 0, 0, None)
        seen.add(found["body_digest"])
    assert len(seen) == 1
    fewer = snapshot_summary(catalog.with_(entries=catalog.entries.where("path <> 'links/00007'")))
    twice = snapshot_summary(catalog.with_(entries=catalog.entries.unionAll(catalog.entries.where("path = 'links/00007'"))))
    assert len({*seen, rows(fewer)[0]["body_digest"], rows(twice)[0]["body_digest"]}) == 3


def test_empty_snapshot_is_imported(spark, target):
    source = catalog_of(spark, [{"id": A, "name": "a"}], [{"id": 4, "drive_id": A}], [])
    assert report(merge.merge_catalog(target, source)) == {"drives_added": 1, "snapshots_imported": 1}
    assert report(merge.merge_catalog(target, source)) == {"drives_merged": 1, "snapshots_skipped": 1}


def test_search_survives_a_flip(spark, tmp_path):
    from archidex.operators.search import search

    store = CatalogStore(spark, str(tmp_path / "indexed"))
    source = source_catalog(spark)
    merge.merge_catalog(store, source)
    before = rows(search(store.load(), "x bin"))
    merge.merge_catalog(store, source, trust=True)
    after = rows(search(store.load(), "x bin"))
    assert len(before) == 1 and {**after[0], "hash": ""} == before[0] and after[0]["hash"] == FULL
