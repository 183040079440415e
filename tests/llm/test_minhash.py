from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from archidex.llm import minhash
from archidex.llm.queries import ORACLES, QUERIES
from tests.check_oracles import connect, differences


def test_query_equals_sql(spark, sf="/root/testdata/sf0.01"):
    assert differences(spark, connect(sf), sf, QUERIES["op11_minhash"], ORACLES["op11_minhash"]) is None


def plain_set(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def plain(rows):
    """Size, smallest id reachable and kept of each row, comparing all sets with all others."""
    sets = [plain_set(text) for _, text, *_ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 80 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    ids = {}
    for g, (key, *_) in zip(group, rows, strict=True):
        if key is not None:
            ids[g] = min(key, ids.get(g, key))
    return sorted(((k, len(s), ids.get(g), k == ids.get(g)) for (k, *_), s, g in zip(rows, sets, group, strict=True)), key=repr)


def found(spark, rows, parts=5):
    given = spark.createDataFrame(rows, "doc_id long, text string, node string, hub long, component_id long").repartition(parts)
    return sorted((tuple(r) for r in minhash.near_duplicates(given).collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.random()) if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 12, 60, 300]))]
        for _ in range(9):
            rows.append(" ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05, 0.07]))))
    common = " ".join(f"legal{i}" for i in range(60))
    rows += [f"{common} own {i} words {rng.random()} of {rng.random()}" + " end" * (i % 9) for i in range(60)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "One two", "one two three four", "a\x0bb c d e", "a b c d e", "é É x y z", "É é x y z"]
    rng.shuffle(rows)
    ids = [*range(len(rows))]
    rng.shuffle(ids)
    return [(None if i % 17 == 5 else i, text, "x", i, -1) for i, text in zip(ids, rows, strict=True)]


def test_equals_comparing_all_pairs(spark):
    rows = corpus(0)
    rows += rows[:6] + [(rows[7][0], "a quite different text of its own here", "x", 0, 0)]
    assert found(spark, rows) == plain(rows)


def test_no_rows_and_only_empty_texts(spark):
    assert found(spark, []) == []
    rows = [(None, None, "x", 1, 1), (1, "", "x", 1, 1), (2, " ", "x", 1, 1)]
    assert found(spark, rows) == plain([(1, ""), (2, " ")]) + [(None, 0, None, True)]


def test_pairs_at_the_bound_itself(spark):
    # 8 of 10 shingles in common is a link, 79 of 99 is not.
    line = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = [(1, " ".join(line("s", 12))), (2, " ".join(line("s", 11) + ["t"])), (3, " ".join(line("u", 4)))]
    rows += [(4, " ".join(line("v", 21))), (5, " ".join(line("v", 19) + ["w0", "w1"])), (6, " ".join(line("v", 20) + ["w0"]))]
    assert [minhash.similar(np.arange(10), np.arange(2, 10), (80, 100)), minhash.similar(np.arange(99), np.arange(20, 99), (80, 100))] == [True, False]
    assert found(spark, [(*r, "x", 0, 0) for r in rows]) == plain(rows)


def test_large_group_without_a_centre_is_whole(spark):
    """A chain: each text is linked to its neighbours only, and all lists are shared by many."""
    words = [f"c{i}" for i in range(1200)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 120]), "x", 0, 0) for i in range(180)]
    got = found(spark, rows)
    assert {(r[2], r[3]) for r in got} == {(0, False), (0, True)} and sum(r[3] for r in got) == 1
    assert got == plain(rows)


def test_rest_alone_finds_all_links_in_small_blocks(spark, monkeypatch):
    """Without the stars, lists compared across components find the same groups, also block by block."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(minhash, "stars", lambda lists, nodes, sets, *_: spark.createDataFrame([], "a long, b long"))
    rows = corpus(4)
    assert found(spark, rows) == plain(rows)


def test_very_long_text_and_its_near_copy(spark):
    rng = random.Random(1)
    words = [f"v{rng.randrange(10**6)}" for _ in range(150_000)]
    near = words[:140_000] + [f"n{i}" for i in range(10_000)]
    rows = [(5, " ".join(words), "x", 0, 0), (3, " ".join(near), "x", 0, 0), (4, " ".join(words[:100_000]), "x", 0, 0)]
    assert [(r[0], r[2]) for r in found(spark, rows)] == [(3, 3), (4, 4), (5, 3)]


def test_threshold_misses_few_pairs():
    t = minhash.match_threshold()
    rng = np.random.default_rng(2)
    assert (rng.binomial(minhash.COORDINATES, 0.8, size=1_000_000) < t).mean() < 5e-5
    agreed = []
    for _ in range(300):  # signatures of real sets agree as often as their similarity says
        pool = rng.integers(0, 1 << 62, size=100).astype(np.uint64)
        a, b = np.sort(pool[:90]), np.sort(pool[10:])
        agreed.append((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(np.mean(agreed) - 0.8) < 0.01


def test_large_group_takes_few_pairs(spark):
    """The pairs compared grow with the number of texts, not with its square."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 0.008)), "x", 0, 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, hub long, component_id long").repartition(4)
    signed = minhash._signed(docs, "doc_id", "text", 4)
    nodes = signed.dropDuplicates(["node"]).withColumn("id", F.xxhash64("node"))
    lists = minhash._lists(minhash.prefixes(nodes, minhash.match_threshold()))
    hubs = lists.groupBy("place", "value").agg(F.max(F.struct("hub", "id")).alias("best"))
    pairs = lists.join(hubs, ["place", "value"]).where("id <> best.id").select("id", "best.id").distinct().count()
    assert pairs < 20 * len(rows)
    got = found(spark, rows)
    assert sum(r[2] == 0 for r in got) > 1400
