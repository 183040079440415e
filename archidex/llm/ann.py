"""Nearest neighbours by inner product: a block matrix join over int8 tiles with error bounds.

Candidates and queries are dealt into blocks of bounded size; each pair of blocks is a tile. In a tile each vector is scale
times int8 values plus a rest of known length, so the product of the int8 matrices gives every inner product within a bound.
The 20th best lower bound of a query rules out all pairs whose upper bound is below it; the others are
computed again in double precision, component after component. Every tile hands on a sorted list for each query, and heaps
merge the lists. The result is exact.

Defined results: null or zero vectors and those with null or non-finite components take no part, nor do rows without an id;
of rows with the same id the smallest vector counts; vectors of different lengths are never compared; fewer candidates than
asked for give them all; ties go to the smaller id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEIGHBOURS = 20
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
LEVELS = 127


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each id that has a finite vector other than zero, as array of float."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector")).where("id is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, length of what they stand for, and length of the rest, of each row."""
    scale = np.abs(x).max(axis=1) / LEVELS
    values = np.rint(x / scale[:, None]).astype(np.int8)
    stand_in = values * scale[:, None]
    return values, scale, np.linalg.norm(stand_in, axis=1), np.linalg.norm(x - stand_in, axis=1)


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer product of two int8 matrices. Sums stay below 2**24 up to 1040 components, so float32 holds them exactly."""
    kind = np.float32 if a.shape[1] * LEVELS * LEVELS < 1 << 24 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, adding component after component: the same for equal vectors anywhere."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def nearest_in_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> list[np.ndarray]:
    """Query number, candidate number and inner product of each query's ``k`` nearest, nearest first."""
    qv, qs, qn, qr = quantised(queries)
    cv, cs, cn, cr = quantised(candidates)
    about = tile_product(qv, cv) * qs[:, None] * cs[None, :]
    # |xy - x'y'| <= |x'| |y - y'| + |x - x'| |y|, and |y| <= |y'| + |y - y'|; a little more for rounding.
    error = qn[:, None] * cr[None, :] + qr[:, None] * (cn + cr)[None, :]
    error += 1e-9 * (qn + qr)[:, None] * (cn + cr)[None, :]
    own = query_ids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, about - error)
    most = min(k, low.shape[1])
    bar = np.partition(low, low.shape[1] - most, axis=1)[:, low.shape[1] - most]
    q, c = np.nonzero((about + error >= bar[:, None]) & ~own)
    scores = np.empty(len(q))
    for a in range(0, len(q), 1 << 16):
        at = slice(a, a + (1 << 16))
        scores[at] = inner_products(queries[q[at]], candidates[c[at]])
    order = np.lexsort((ids[c], -scores, q))
    q, c, scores = q[order], c[order], scores[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return [q[keep], c[keep], scores[keep]]


def _matrix(group: pa.Table, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    vectors = group.column(vector).combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return group.column(key).to_numpy(), flat.reshape(len(vectors), -1)


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        else:
            query_ids, queries = _matrix(left, "query_id", "query")
            ids, candidates = _matrix(right, "id", "vector")
            q, c, scores = nearest_in_tile(query_ids, queries, ids, candidates, k)
            found = [query_ids[q], ids[c], scores]
        return pa.Table.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def _merge(k: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        tiles: dict[tuple, list] = {}
        for tile, score, vec_id in zip(*(group.column(c).to_pylist() for c in ("tile", "score", "vec_id")), strict=True):
            tiles.setdefault(tile, []).append((-score, vec_id))
        best = list(islice(heapq.merge(*map(sorted, tiles.values())), k))
        return pa.table(
            {
                "query_id": pa.array([key[0].as_py()] * len(best), pa.int64()),
                "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([i for _, i in best], pa.int64()),
                "score": pa.array([-s for s, _ in best], pa.float64()),
            }
        )

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest of each row of ``usable`` vectors that ``is_query`` holds for."""
    sizes = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    n_candidate_blocks, n_query_blocks = (max(1, -(-n // size)) for n, size in zip(sizes, (CANDIDATE_BLOCK, QUERY_BLOCK), strict=True))
    length = F.size("vector")
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Every column gets a name of its own: the two sides of a cogroup may not share columns of one parent.
    queries = vectors.where(is_query).select(
        F.col("id").alias("query_id"), F.col("vector").alias("query"), length.alias("query_length"),
        block(n_query_blocks).alias("query_block"), every(n_candidate_blocks).alias("candidate_block"),
    )
    candidates = vectors.select(
        F.col("id").alias("id"), F.col("vector").alias("vector"), length.alias("length"),
        every(n_query_blocks).alias("q"), block(n_candidate_blocks).alias("c"),
    )
    tiles = queries.groupBy("query_length", "query_block", "candidate_block").cogroup(candidates.groupBy("length", "q", "c"))
    found = tiles.applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    found = found.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(n_candidate_blocks)))
    return found.groupBy("query_id").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
