from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from archidex.operators import impact, postings
from archidex.operators.search import search_all, search_scan
from archidex.sources.store import CatalogStore
from tests.conftest import catalog_of, entry
from tests.test_search import QUERIES, catalog, found, in_order  # noqa: F401

WORDS = ["blue", "green", "blueish", "gear", "box", "note", "b", "bb", "a"]


@pytest.fixture(scope="module")
def small_blocks():
    patch = pytest.MonkeyPatch()
    patch.setattr(impact, "BLOCK_BITS", 2)
    patch.setattr(impact, "FIRST_BLOCKS", 1)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def index(catalog, small_blocks, tmp_path_factory):  # noqa: F811
    return impact.build(catalog, str(tmp_path_factory.mktemp("impact") / "i"))


@pytest.mark.parametrize("query", [*QUERIES[1:17:3], "o", "aurora aurora a", "notthere aurora", "-"])
def test_equals_a_scan(catalog, index, query):  # noqa: F811
    for limit in (3,):
        assert in_order(impact.search_topk(catalog, index, query, limit=limit)) == in_order(search_scan(catalog, query, limit=limit))


def test_drive(catalog, index):  # noqa: F811
    one = "drv_000000000002"
    assert in_order(impact.search_topk(catalog, index, "aurora", one, 2)) == in_order(search_scan(catalog, "aurora", one, 2))


@pytest.fixture(scope="module")
def wide(spark, small_blocks, tmp_path_factory):
    """Names and folders of all lengths, in two scans of which the second is current, with many ties."""
    drive = {"id": "drv_00000000000e", "name": "Wide", "latest_snapshot_id": 2}
    word = lambda i, k: WORDS[(i * 7 + k * k * 3 + i // 9) % len(WORDS)]
    paths = {"/".join(" ".join(word(i, k) for k in range(1 + (i + j) % 4)) for j in range(1 + i % 4)) + f" {i % 60}" for i in range(700)}
    paths |= {" ".join(["blue"] * n) for n in range(1, 9)} | {f"deep/{'x' * 40} {i}/blue" for i in range(30)}
    entries = [entry(s, p, size=1) for s in (1, 2) for p in sorted(paths)]
    whole = catalog_of(spark, [drive], [{"id": s, "drive_id": drive["id"]} for s in (1, 2)], entries)
    stored = CatalogStore(spark, str(tmp_path_factory.mktemp("wide")), index=False).publish(whole, new_entries=whole.entries)
    return stored, impact.build(stored, str(tmp_path_factory.mktemp("impact") / "w"))


@pytest.mark.parametrize("query", ["b", "green gear", "x" * 36, "'blue blue'"])
def test_pages_are_heads_of_all_hits(wide, query):
    stored, index = wide
    for limit in (1, 60):
        hits, read, total = impact.search_topk_counted(stored, index, query, limit=limit)
        assert in_order(hits) == in_order(search_scan(stored, query, limit=limit))
        assert 0 <= read <= total


def test_blocks_read_fall_with_the_page(wide):
    stored, index = wide
    read = [impact.search_topk_counted(stored, index, "blue", limit=k)[1:] for k in (1, 20, 400)]
    assert read[0][0] < read[1][0] <= read[2][0] <= read[0][1] and read[0][0] * 5 < read[0][1]


def test_counts_of_entries_come_from_blocks(wide):
    stored, index = wide
    for phrase in ("blue", "b", "blue blue", "gear", "x" * 33, "zzz", "1", "note box"):
        want = len({(r.snapshot_id, r.path) for r in stored.entries.collect() if f" {phrase}" in " " + r.path.replace("/", " ")})
        assert impact.containing(index, phrase) == want, phrase


def test_empty_catalog(spark, tmp_path):
    none = catalog_of(spark, [], [], [])
    index = impact.build(none, str(tmp_path / "none"))
    assert impact.search_topk(none, index, "blue").count() == 0 == search_all(none, "blue").count()


def test_tasks_follow_the_rows(spark, wide, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "ROWS_A_TASK", 500)
    stored, index = wide
    count = index.rows.count()
    blocks = impact._blocks(index.rows, count)
    text = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in text and "Aggregate" not in text[text.index("Exchange") :]  # no task sorts what a split of files holds
    assert blocks.rdd.getNumPartitions() == postings.sorting_tasks(count) > 4
    again = impact.build(stored, str(tmp_path / "again"))
    sizes = [r["count"] for r in again.rows.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == count
    kept = ["first", "last", "top", "length", "fresh"]
    by_block = index.rows.groupBy("block").agg(F.min("suffix").alias("first"), F.max("suffix").alias("last"), F.count("*").alias("n"))
    found = {r["block"]: (r["first"], r["last"]) for r in by_block.collect()}
    assert {r["block"]: (r["first"], r["last"]) for r in blocks.select("block", *kept).collect()} == found
    assert in_order(impact.search_topk(stored, again, "b", limit=60)) == in_order(impact.search_topk(stored, index, "b", limit=60))
