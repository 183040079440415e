from __future__ import annotations

import re
import sqlite3
from collections import Counter

import pytest

from archidex.operators.search import search, search_all, search_batch, search_index, search_index_all, search_scan
from archidex.sources.store import CatalogStore
from tests.conftest import catalog_of, entry, rows

NAMES = [
    "Photos/2024/Aurora/aurora_final.mov", "Photos/2024/Aurora/aurora-a.jpg", "Photos/aurora aurora aurora.txt",
    "Docs/Äpfel/Übersicht été.pdf", "Docs/apfel/ubersicht.doc", "Docs/a a a/a.txt", "Music/Final Cut/final.mp3",
    "Music/final_aurora/track 01.flac", "x/AURORA", "Old/aurora_abandoned.tmp", "Docs/東京/旅行.txt", "a/b/c/d",
]
QUERIES = [
    "aurora", "aurora final", "aurora_a", '"final"', "a", "'a a'", "a_a", "ubersicht ete", "Äpfel", "fin cut", "01", "zzz",
    "aurora -", "東京", "docs/a", "aurora aurora", "photos 2024 mov", "-", "",
]


@pytest.fixture(scope="module")
def catalog(spark):
    first = [entry(1, p, size=1) for p in NAMES[:10]]
    second = [entry(2, p, size=1) for p in NAMES[1:]]
    third = [entry(3, f"Elsewhere/{p}", size=2) for p in NAMES[3:9]]
    return catalog_of(
        spark,
        [{"id": "drv_000000000001", "name": "One", "latest_snapshot_id": 2},
         {"id": "drv_000000000002", "name": "Two", "latest_snapshot_id": 3}],
        [{"id": 1, "drive_id": "drv_000000000001"}, {"id": 2, "drive_id": "drv_000000000001"},
         {"id": 3, "drive_id": "drv_000000000002"}],
        first + second + third,
    )


@pytest.fixture(scope="module")
def indexed(spark, catalog, tmp_path_factory):
    store = CatalogStore(spark, str(tmp_path_factory.mktemp("index")))
    return store.publish(catalog, new_entries=catalog.entries)


def expected(catalog, query, limit=100):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, path, tokenize='unicode61 remove_diacritics 2')")
    con.execute("create table e(id integer primary key, snapshot int, name text, path text)")
    for row in catalog.entries.collect():
        con.execute("insert into t(rowid, name, path) values(?,?,?)", (row.id, row["name"], row.path))
        con.execute("insert into e values(?,?,?,?)", (row.id, row.snapshot_id, row["name"], row.path))
    parts = [p.strip("\"'") for p in query.split()]
    match = " AND ".join('"' + p.replace('"', '""') + '"*' for p in parts if p)
    if not match:
        return []
    found = con.execute(
        "select snapshot, e.path, bm25(t, 8.0, 1.0) from t join e on e.id = t.rowid where t match ? and snapshot in (2, 3) "
        "order by 3, e.name collate nocase", (match,),
    ).fetchall()
    return sorted((s, p, round(score, 9)) for s, p, score in found[:limit])


def found(df):
    return sorted((r.snapshot_id, r.path, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("query", QUERIES)
def test_search_matches_sqlite(catalog, indexed, query):
    want = expected(catalog, query)
    assert found(search_scan(catalog, query)) == want
    assert found(search(indexed, query)) == want


def test_batch_equals_single(catalog, indexed):
    hits = search_batch(indexed, QUERIES, limit=100)
    by_query = {q: [] for q in QUERIES}
    for r in hits.collect():
        by_query[r["query"]].append((r.snapshot_id, r.path, round(r.score, 9)))
    for query in QUERIES:
        assert sorted(by_query[query]) == expected(catalog, query), query


@pytest.mark.parametrize("size", [1, 50, 51, 5000])
def test_batches_of_any_size_give_the_same_rows(catalog, indexed, monkeypatch, size):
    """Also beside phrases that nothing has, and with and without the test inside the scan."""
    from archidex.operators import search as module

    monkeypatch.setattr(module, "TESTED_KEYS", 10_000 if size != 51 else 0)
    texts = ["aurora final", "a a", "a", "fin cut", "docs/a"]
    asked = [texts[i] if i < 5 else f"zz{i}" if i % 2 else f"a{i}q" for i in range(size)]
    by_query = {}
    for r in search_batch(indexed, asked, limit=3).collect():
        by_query.setdefault(r["query"], []).append((r.snapshot_id, r.path, round(r.score, 9)))
    assert {q: sorted(v) for q, v in by_query.items()} == {q: expected(catalog, q, 3) for q in texts[:size]}


def test_ranges_of_sorted_suffixes_meet_all_phrases():
    from archidex.operators.search import _ranges

    suffixes = sorted(["a", "a b", "aa", "ab c", "b", "ba", "é", "é x", "東", "東京", "𐐀 z"])
    phrases = sorted({s[:n] for s in suffixes for n in range(1, 4)} | {"0", "aaa", "zz", "\U0010fffe"})
    known = {p: i for i, p in enumerate(phrases)}
    for a in range(len(suffixes)):
        for b in range(a + 1, len(suffixes) + 1):
            got = {(phrases[n], suffixes[a + k]) for n, i, j in _ranges(suffixes[a:b], phrases, known) for k in range(i, j)}
            assert got == {(p, s) for p in phrases for s in suffixes[a:b] if s.startswith(p)}


def test_whole_forms_have_every_hit(catalog, indexed):
    assert found(search_all(catalog, "a")) == found(search_index_all(indexed, "a")) == expected(catalog, "a")


def in_order(df):
    return [(r.path, round(r.score, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Equal scores and names in many folders, in three batches of which the middle one has no index."""
    drive = {"id": "drv_00000000000d", "name": "Ties", "latest_snapshot_id": 3}
    snapshots = [{"id": i, "drive_id": drive["id"]} for i in (1, 2, 3)]
    folders = {1: ["q5", "q1"], 2: ["z3", "b2"], 3: ["m9", "a4", "x7", "k0", "c1"]}
    entries = [entry(s, f"{f}/tied mark", size=1) for s, names in folders.items() for f in names]
    whole = catalog_of(spark, [drive], snapshots, entries)
    root = str(tmp_path_factory.mktemp("mixed"))
    stored = None
    for s in (1, 2, 3):
        part = whole.entries.where(f"snapshot_id = {s}").drop("id")
        stored = CatalogStore(spark, root, index=s != 2).publish(whole, new_entries=part)
    return whole, stored


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 100])
def test_limit_inside_a_tie_gives_the_same_rows_in_every_form(tied, limit):
    whole, stored = tied
    assert stored.postings is not None
    want = [f"{f}/tied mark" for f in ("a4", "c1", "k0", "m9", "x7")][:limit]
    scanned = in_order(search_scan(stored, "tied", limit=limit))
    assert [p for p, _ in scanned] == want
    assert in_order(search_index(stored, "tied", limit=limit)) == scanned
    assert in_order(search_batch(stored, ["tied"], limit=limit)) == scanned
    # The figures count the batch without an index, too.
    assert in_order(search_scan(whole, "tied", limit=limit)) == scanned


def test_limits_and_drive(catalog, indexed):
    assert len(rows(search(indexed, "aurora", limit=2))) == 2
    with pytest.warns(UserWarning, match="501"):
        assert len(rows(search(indexed, "aurora", limit=501))) == len(expected(catalog, "aurora"))
    other = rows(search(indexed, "aurora", drive_id="drv_000000000002"))
    assert {r["drive_name"] for r in other} == {"Two"}
    # Corpus figures do not depend on the drive.
    assert {r["score"] for r in other} <= {r["score"] for r in rows(search(indexed, "aurora"))}


def test_words_of_real_addresses(spark, tmp_path):
    """Every word of the given pages' addresses is found as often as the addresses hold it."""
    from archidex.plans.derive import library_catalog, table

    sf = "/root/testdata/sf0.001"
    catalog = library_catalog(table(spark, sf, "pages"), table(spark, sf, "part"))
    stored = CatalogStore(spark, str(tmp_path / "c")).publish(catalog, new_entries=catalog.entries)
    paths = [r.path for r in stored.entries.where("snapshot_id = 2").select("path").collect()]
    words = Counter(w for p in paths for w in set(re.findall("[a-z0-9]+", p.lower())))
    rare, common = min(words, key=lambda w: (words[w], w)), max(words, key=lambda w: (words[w], w))
    for word in (rare, common, "nosuchword"):
        want = sum(any(w.startswith(word) for w in re.findall("[a-z0-9]+", p.lower())) for p in paths)
        hits = search_index_all(stored, word).where("drive_name = 'Web pages'")
        assert hits.count() == want
