from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archidex.llm import vectorcodes
from archidex.llm.queries import ORACLES, QUERIES
from tests.check_oracles import connect, differences


def test_query_equals_sql(spark, sf="/root/testdata/sf0.01"):
    assert differences(spark, connect(sf), sf, QUERIES["op12_vector_codes"], ORACLES["op12_vector_codes"]) is None


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8, 13])
def test_transform_is_scaled_and_in_order_of_sign_changes(width):
    rng = np.random.default_rng(width)
    x, y = rng.integers(-500, 500, size=(2, 6, width))
    a, b = vectorcodes.walsh(x), vectorcodes.walsh(y)
    n = a.shape[1]
    assert n >= width and n & (n - 1) == 0
    assert (((a - b) ** 2).sum(axis=1) == n * ((x - y) ** 2).sum(axis=1)).all()
    matrix = vectorcodes.walsh(np.eye(n, dtype=np.int64)).T
    assert [(row[1:] != row[:-1]).sum() for row in matrix] == list(range(n))


numbers = st.one_of(st.integers(-6, 6), st.integers(-(1 << 62), 1 << 62))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda w: st.tuples(
    st.lists(st.lists(numbers, min_size=w, max_size=w), min_size=1, max_size=12),
    st.lists(st.lists(numbers, min_size=w, max_size=w), min_size=1, max_size=9),
)))
def test_nearest_equals_trying_all(case):
    parts, entries = case
    codes, errors = vectorcodes.nearest(np.array(parts, dtype=np.int64), np.array(entries, dtype=np.int64))
    for part, code, error in zip(parts, codes.tolist(), errors.tolist(), strict=True):
        all_of = [sum((x - y) ** 2 for x, y in zip(part, e, strict=True)) for e in entries]
        assert (error, code) == (min(all_of), all_of.index(min(all_of)))


def plain(rows, parts=16, entries=64, rounds=2):
    """Codes, errors, label errors and digest by the definition, with Python's integers."""
    usable = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    held = lambda x: math.floor(min(max(256 * x, -(2.0**62)), 2.0**62))
    usable = [(i, [held(float(np.float32(x))) for x in v], label) for i, v, label in usable]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not usable:
        return []
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    width = len(usable[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in usable]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(best(p, c[p])[1], []).append(c[p])
            mean = lambda g: [sum(x) // len(g) for x in zip(*g, strict=True)]
            moved.append([mean(groups[k]) if k in groups else e for k, e in enumerate(books[p])])
        books = moved
    found = [[best(p, c[p]) for p in range(parts)] for c in cut]
    errors = [min(sum(d for d, _ in f), (1 << 63) - 1) for f in found]
    of_label = {}
    for (_, _, label), e in zip(usable, errors, strict=True):
        of_label[label] = of_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{k:02x}" for _, k in f), e, min(of_label[r[2]], (1 << 63) - 1), digest) for r, f, e in zip(usable, found, errors, strict=True)),
        key=repr,
    )


SCHEMA = "vec_id long, embedding array<float>, label int, id string, n long, values string"


def found(spark, rows):
    vectors = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    coded, books = vectorcodes.compress(vectors)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    out = coded.select("vec_id", code, "error", "label_error", F.lit(vectorcodes.digest(books)))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    vector = lambda n=48: [float(x) for x in rng.normal(scale=0.3, size=n).astype(np.float32)]
    rows = [(i, vector(), i % 5 if i % 7 else None) for i in range(150)]
    rows += [rows[3], rows[3], (3, vector(), 1), (None, vector(), 2), (None, vector(), None)]
    rows += [(200, None, 1), (201, [], 1), (202, vector(47), 1), (203, vector(64), 1), (204, [*vector(47), None], 1)]
    rows += [(205, [*vector(47), float("nan")], 1), (206, [*vector(47), float("-inf")], 1), (207, [0.0] * 48, 9), (208, [-0.0] * 48, 9)]
    assert found(spark, rows) == plain(rows)
    rows += [(300, [3e9] * 48, 1), (301, [-3e9, *vector(47)], 1), (-5, [1e30, -1e30] * 24, 2), (-4, vector(), 2)]
    assert found(spark, rows) == plain(rows)


def test_few_and_no_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1), (2, [1.0] * 15, 1)]) == []
    few = [(4, [0.5, -0.5] * 8, 1), (2, [1 / 3] * 16, None)]
    assert found(spark, few) == plain(few)


def test_decoded_entries_are_as_far_as_the_error_says(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = vectorcodes.integer_vectors(vectors, F.col("vec_id").alias("id")).withColumnRenamed("values", "own")
    coded, books = vectorcodes.compress(vectors)
    both = vectorcodes.decode(coded, books).join(whole, F.col("vec_id") == F.col("id"))
    gap = F.aggregate(F.zip_with("own", "values", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    assert both.where(gap != F.col("error")).count() == 0 < both.count()
