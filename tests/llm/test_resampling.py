from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest

from archidex.llm import resampling
from archidex.llm.queries import ORACLES, QUERIES
from tests.check_oracles import connect, differences


def test_query_equals_sql(spark, sf="/root/testdata/sf0.01"):
    assert differences(spark, connect(sf), sf, QUERIES["op13_resampling"], ORACLES["op13_resampling"]) is None


def runs(text, longest):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    found = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), found


def plain(docs, target, longest, buckets, share, least, seed):
    def counted(texts):
        totals = [0] * buckets
        for text in texts:
            for f in runs(text, longest)[1]:
                totals[zlib.crc32(f.encode()) % buckets] += 1
        return totals

    s, t = counted([d[1] for d in docs]), counted(target)
    sums = float(sum(s) + buckets), float(sum(t) + buckets)
    gain = [math.floor(1000 * math.log(float(b + 1) * sums[0] / (float(a + 1) * sums[1]))) for a, b in zip(s, t, strict=True)]
    rows = []
    for key, text, *_ in docs:
        n_words, found = runs(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, n_words, len(found), weight, score))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = len(order) * share[0] // share[1]
    ranked = [(*r, k if k <= drawn else None) for k, r in enumerate(order, start=1)]
    return sorted(ranked + [(*r, None) for r in rows if r[1] < least], key=repr)


TEXTS = [
    None, "", " \t--", "one", "One two, two; TWO two", "É é ÉCOLE école 漢字 \x00x", "a" * 3000 + " b", "tail word-", "-lead word",
    "9 99 999 x9 9x", "the house of the dog is not red", "repeated words repeated words repeated words",
] + [f"document {i} speaks of thing {i % 3} and of nothing else at all" for i in range(40)]
TARGET = ["the dog speaks of thing 1", None, "", "Two two. words", "never seen elsewhere"]


@pytest.mark.parametrize(("longest", "buckets", "least"), [(1, 10_000, 4), (3, 50, 3), (2, 1, 0)])
def test_equals_plain_counting(spark, longest, buckets, least):
    docs = [(None if i == 9 else i - 20, t, "w", 5, "s") for i, t in enumerate(TEXTS)]
    docs += docs[10:12] * 2 + [(None, TEXTS[15], "w", 5, "s"), (7, "long " * 30_000 + "end", "w", 5, "s")]
    given = spark.createDataFrame(docs, "doc_id long, text string, weight string, rank int, key string").repartition(4)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resampling.resample(given, target, share=(30, 100), least_words=least, seed=11, longest=longest, buckets=buckets)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == plain(docs, TARGET, longest, buckets, (30, 100), least, 11)


def test_no_documents_and_no_target(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    row = resampling.resample(docs, none.select("text"), share=(1, 1), least_words=1).first()
    assert row["n_features"] == 3 and row["rank"] == 1


def test_ranks_over_many_partitions_are_whole(spark):
    rows = spark.range(20_000).selectExpr("id % 300 as score", "id div 7 as key").repartition(16)
    order = rows.score.desc(), rows.key.asc()
    ranked = resampling.ranked(rows, *order).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 20_001))
    in_order = [(-r["score"], r["key"]) for r in sorted(ranked, key=lambda r: r["rank"])]
    assert in_order == sorted(in_order)
