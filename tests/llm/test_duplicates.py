from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from archidex.llm import decontam, linededup, simhash
from archidex.llm.queries import ORACLES, QUERIES
from archidex.llm.queries_duplicates import op1_simhash, op9_decontam
from tests.check_oracles import connect, differences

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, prints):
    """Smallest id reachable over links of at most four bits, by comparing everything with everything."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in rows]
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in ids}


def test_spark_hash_is_the_one_meant(spark):
    got = spark.sql("select xxhash64('a b c d') as h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def check_components(found, rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(rows, prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{prints[i]:016x}", want[i]) for i, _ in rows}


def test_simhash_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    check_components(op1_simhash(spark, SF).collect(), docs)


@pytest.mark.parametrize("block", [2, 5, 2048])
def test_links_of_crowded_points(spark, monkeypatch, block):
    """Chains and clusters of fingerprints a few bits apart, also when every point is passed on in blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    prints = set()
    for _ in range(6):
        centre = last = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(40):
            near = centre if rng.random() < 0.7 else last
            last = near ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            prints.add(last)
    prints |= {0, (1 << 64) - 1, 15, 31}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fingerprint long"))
    labels = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components([(s, None) for s in signed], dict(zip(signed, prints, strict=True)))
    groups, expected = {}, {}
    for s in signed:
        groups.setdefault(labels.get(s, s), set()).add(s)
        expected.setdefault(want[s], set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(-5, -7), (300, 300)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100), -5: -7, -7: -7}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_odd_documents(spark):
    texts = [None, "", " \n", "One", "one", "a b c", "A B\tc", "w " * 20000, "w " * 20001, "x y z u", "x y z u"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, fingerprint int, component_id string")
    found = simhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    check_components(found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))).collect(), rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    repeated = simhash.near_duplicates(docs.unionAll(docs.where("doc_id = 3")))
    assert repeated.where("doc_id = 3").count() == 2
    nameless = simhash.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert nameless.count() == len(texts) and nameless.where("component_id is not null").count() == 0


# -- lines --------------------------------------------------------------------------------


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_line_query_equals_sql(spark, sf):
    assert differences(spark, connect(sf), sf, QUERIES["op2_line_dedup"], ORACLES["op2_line_dedup"]) is None


def cleaned(spark, rows, schema="doc_id long, text string"):
    out = linededup.drop_repeated_lines(spark.createDataFrame(rows, schema))
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}


def test_lines_with_variable_fields(spark):
    rows = [
        (1, "page 1 of 20 printed by anna\nthe quick fox\nown text of the first"),
        (2, "page 2 of 37 printed  by anna \nown text of the second here\nyes"),
        (3, "yes\npage 7 of 9 printed by bert\nthe quick fox\nyes"),
        (4, "page x of many other words here\nthe quick dog"),
    ]
    # The printer's name varies but most lines agree with the template in the tokens after the leading three.
    got = cleaned(spark, rows)
    assert got[1] == (rows[0][1], 3, 0)
    assert got[2] == ("own text of the second here\nyes", 3, 1)
    assert got[3] == ("yes\npage 7 of 9 printed by bert\nyes", 4, 1) or got[3] == ("yes\nyes", 4, 2)
    assert got[4] == (rows[3][1], 2, 0)


def test_agreement_decides_who_belongs_to_a_template(spark):
    shared = "alpha beta gamma one two three four five six {} end"
    rows = [(i, shared.format(w)) for i, w in enumerate(["red", "blue", "green", "gold"])]
    rows.append((9, "alpha beta gamma none of that is like the others"))
    got = cleaned(spark, rows)
    assert [got[i][2] for i in (0, 1, 2, 3, 9)] == [0, 1, 1, 1, 0]


def test_lines_of_odd_documents(spark):
    line = "this line is boilerplate that recurs"
    rows = [
        (None, f"{line}\na"), (None, f"{line}\nb"), (5, None), (6, ""), (7, "\n\n"), (8, f"{line}\n{line}\nc"), (8, f"{line}\n{line}\nc"),
        (8, f"other\n{line}"), (9, "\n".join(["x y"] * 3000 + [line] * 3000 + ["z"])),
    ]
    schema = "doc_id long, text string, _marks int, id int, copy int, n_lines string, hash string"
    given = spark.createDataFrame([(*r, 1, 2, 3, "n", "h") for r in rows], schema)
    out = linededup.drop_repeated_lines(given)
    assert out.columns == ["doc_id", "text", "_marks", "id", "copy", "hash", "n_lines", "n_dropped"]
    found = out.collect()
    assert len(found) == len(rows)
    kept = [r for r in found if r.text and line in r.text]
    # Null ids come first, of which the smaller text hash keeps its line; every copy of one document is treated alike.
    assert len(kept) == 1 and kept[0].doc_id is None
    by = {(r.doc_id, r.text): r for r in found}
    assert (5, None) in by and (6, "") in by and (7, "\n\n") in by and by[8, "other"].n_dropped == 1
    assert sum(r.doc_id == 8 and r.text == "c" and r.n_dropped == 2 for r in found) == 2
    assert by[9, "\n".join(["x y"] * 3000 + ["z"])].n_dropped == 3000
    assert linededup.drop_repeated_lines(given.limit(0)).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = linededup.drop_repeated_lines(table(spark, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- benchmark passages ---------------------------------------------------------------------


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_least_distance_equals_the_table():
    rng = random.Random(3)
    for _ in range(500):
        item, text = ("".join(rng.choice("abé") for _ in range(rng.randrange(1, n))) for n in (14, 25))
        want = plain_distance(item, text)
        assert decontam.least_distance(item, text, 99) == want
        assert want == 0 or decontam.least_distance(item, text, want - 1) is None


def damaged(rng, text, rate):
    letters = list(text)
    for _ in range(int(rate * len(letters))):
        at = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[at] = rng.choice("abcdefgh ")
        elif kind == 1:
            letters.insert(at, rng.choice("abcdefgh "))
        elif len(letters) > 1:
            del letters[at]
    return "".join(letters)


def test_recall_on_damaged_passages(spark):
    """Every benchmark item, edited at random and put between whole documents, against the exact distance."""
    items = [r.text for r in table(spark, "benchmark", "/root/testdata/sf0.1").orderBy("item_id").collect()]
    around = [r.text for r in table(spark, "documents").orderBy("doc_id").limit(50).collect()]
    index, rng, near, found, wrong = decontam.Index(items), random.Random(11), 0, 0, 0
    for rate in (0.0, 0.05, 0.1, 0.15, 0.18):
        copies = [damaged(rng, i, rate) for i in items]
        texts = [f"{around[k % 50][:400]} {c.upper()}\n\n {around[-1 - k % 50][:400]}" for k, c in enumerate(copies)]
        for k, hits in enumerate(index.search(texts)):
            hits = dict(hits)
            exact = plain_distance(index.items[k], decontam.normal(copies[k])) if rate else 0
            if exact <= index.allowed[k]:
                near += 1
                found += k in hits
            wrong += any(d > index.allowed[i] for i, d in hits.items())
    assert near > 800 and found >= 0.97 * near and wrong == 0


def test_decontamination_equals_brute_force(spark):
    """Exact search of every item in every text, for the documents of a small table."""
    docs = {r.doc_id: decontam.normal(r.text) for r in table(spark, "documents").collect()}
    items = {r.item_id: decontam.normal(r.text) for r in table(spark, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): r for r in op9_decontam(spark, SF).collect()}
    allowed = {i: int(0.2 * len(t) + 1e-9) for i, t in items.items()}
    want = {}
    for d, text in docs.items():
        for i, item in items.items():
            distance = decontam.least_distance(item, text, allowed[i])
            if distance is not None:
                want[d, i] = distance
    assert set(got) == set(want)
    assert all(got[k].distance == want[k] and got[k].item_chars == len(items[k[1]]) for k in got)


def test_passages_in_odd_documents(spark, monkeypatch):
    item = "It was the best of times and it was the worst of times for Ünïcode, they said, so we measured it twice"
    rows = [(1, None), (2, ""), (3, item), (4, "x " * 9000 + item.upper() + " y" * 9000), (5, "times"), (6, f"{item} {item[:-9]} {item}"), (3, item)]
    docs = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, key string, item int")
    items = [(7, item), (7, item), (8, None), (9, " "), (10, "short one"), (11, item + " and a rather different end that nothing has at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)  # several passes
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(docs, bench).collect())
    assert got == [(3, 7, 0), (3, 7, 0), (4, 7, 0), (6, 7, 0)]
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "a short one, it is")], "doc_id long, text string")
    assert [r.item_id for r in decontam.leaks(short, bench).collect()] == [10]


def test_walks_of_equal_windows_are_equal():
    data = np.frombuffer(b"abc def ghi\0zz abc def ghi\0", dtype=np.uint8)
    starts = decontam.word_starts(data)
    assert starts.tolist() == [0, 4, 8, 12, 15, 19, 23]
    for _, values, _ in decontam.window_hashes(data, starts, decontam.walks()):
        assert values[:3].tolist() == values[4:].tolist()
