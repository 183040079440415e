"""SimHash near-duplicates by multi-index hashing.

Each fingerprint of 64 bits has two segments of 32. Two fingerprints that differ in at most four bits differ in at most
two bits of one of the segments, so the Hamming balls of radius one around their values of that segment meet. The
table of all ball points is shuffled by point; a task reads each point's fingerprints in order, verifies whole distances and
keeps a spanning forest of the links, never all pairs. A point with more than ``BLOCK`` fingerprints is passed on
and compared block by block in many tasks. Components come from alternating star contractions.

Equal fingerprints are one node from the start, so copies cost nothing. Links of distinct fingerprints are found exactly.

Defined results: null, empty and blank texts have no shingles and fingerprint zero, and link like any other; fewer words
than a shingle make one shingle of them all; a tie of bits counts as unset. component_id is the smallest doc_id
reachable, null where all ids of the component are null. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.llm.common import sliced
from archidex.session import cut_lineage

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENT_BITS = 32
BLOCK = 2048
EDGES_PER_FILE = 500_000
COUNTED_AT_ONCE = 1 << 16


def shingle_digests(text: str | None, width: int = SHINGLE_WORDS) -> bytes:
    """The 64-bit hashes of the text's shingles. Splitting and lower-casing bytes touch ASCII only."""
    words = (text or "").encode().lower().split()
    if not words:
        return b""
    joined, width = b" ".join(words), min(width, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)])


def fingerprint(text: str | None) -> bytes:
    """The text's 64 bits, most significant first."""
    rows = np.frombuffer(shingle_digests(text), dtype=np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(rows), COUNTED_AT_ONCE):
        counts += np.unpackbits(rows[a : a + COUNTED_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(rows)).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``fingerprint`` (the 64 bits as a long) of each document. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            bits = b"".join(map(fingerprint, part.column("text").to_pylist()))
            values = np.frombuffer(bits, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(values)], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(run, f"key {kind}, fingerprint long").withColumnRenamed("key", key)


def ball_points(points: DataFrame) -> DataFrame:
    """``point`` (segment and value within one bit of the fingerprint's) for each distinct ``fingerprint``."""
    low = F.col("fingerprint").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fingerprint", SEGMENT_BITS)
    masks = [0, *(1 << b for b in range(SEGMENT_BITS))]
    balls = [high.bitwiseXOR(F.lit(m).cast("long")) for m in masks]
    balls += [low.bitwiseXOR(F.lit(m | 1 << SEGMENT_BITS).cast("long")) for m in masks]
    return points.select(F.explode(F.array(*balls)).alias("point"), "fingerprint")


def forest(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints, as pairs of arrays."""
    edges, rest = [], points
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            point = reached.pop()
            near = np.bitwise_count(rest ^ point) <= DISTANCE
            if near.any():
                found = rest[near]
                edges.append((np.full(len(found), point), found))
                reached.extend(found)
                rest = rest[~near]
    return edges


EDGE, MEMBER = 0, 1
_FOUND = ["kind", "a", "b", "block"]


def _found(kind: int, a: np.ndarray, b: np.ndarray, block: np.ndarray | int = 0) -> pa.RecordBatch:
    n = len(a)
    block = np.broadcast_to(np.asarray(block, dtype=np.int64), n)
    columns = [np.full(n, kind, dtype=np.int32), a.view(np.int64), b.view(np.int64), np.ascontiguousarray(block)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _FOUND)


def _points_in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each small point, members (with their block's number) of each large one; input in order of points."""
    points = np.empty(0, dtype=np.uint64)
    prints = np.empty(0, dtype=np.uint64)
    large, passed = None, 0  # the point being passed on, and how many of its members were

    def settle(points: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Complete points: all of a point's fingerprints are here."""
        starts = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(points)]]))
        two = starts[sizes == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= DISTANCE]
        edges = [(prints[near], prints[near + 1])]
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            edges += forest(prints[a : a + n])
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield _found(EDGE, pairs[0].copy(), pairs[1].copy())

    for batch in batches:
        points = np.concatenate([points, batch.column("point").to_numpy().view(np.uint64)])
        prints = np.concatenate([prints, batch.column("fingerprint").to_numpy().view(np.uint64)])
        while len(points):
            if large is not None:
                n = int(np.searchsorted(points, large, side="right"))
                if n:
                    yield _found(MEMBER, points[:n], prints[:n], (passed + np.arange(n)) // BLOCK)
                    passed += n
                points, prints = points[n:], prints[n:]
                if len(points):
                    large = None
                continue
            starts = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(points)]]))
            too_large = np.flatnonzero(sizes > BLOCK)
            first = int(too_large[0]) if len(too_large) else len(starts) - 1
            cut = int(starts[first])  # what is before the first large or the last, perhaps incomplete, point
            if cut:
                yield from settle(points[:cut], prints[:cut])
            points, prints = points[cut:], prints[cut:]
            if not len(too_large):
                break
            large, passed = points[0], 0
    if large is None and len(points):
        yield from settle(points, prints)


def _block_pair(group: pa.Table) -> pa.Table:
    prints = np.unique(group.column("b").to_numpy().view(np.uint64))
    edges = forest(prints)
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (prints[:0], prints[:0])
    columns = [pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))]
    return pa.Table.from_arrays(columns, ["a", "b"])


def links(points: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints within the distance that connect all that are within it."""
    near = ball_points(points).repartition("point").sortWithinPartitions("point", "fingerprint")
    found = cut_lineage(near.mapInArrow(_points_in_order, "kind int, a long, b long, block long"))
    members = found.where(F.col("kind") == MEMBER).select("a", "b", "block")
    blocks = members.groupBy("a").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), "last"))
    pairs = members.join(blocks, "a").select("a", "b", "block", other.alias("other"))
    pairs = pairs.select("a", "b", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    from_large = pairs.groupBy("a", "p", "q").applyInArrow(_block_pair, "a long, b long")
    return found.where(F.col("kind") == EDGE).select("a", "b").unionAll(from_large).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for each node of the edges ``a``, ``b``.

    Large and small star steps in turn: each node hands its larger, then its smaller neighbours to its smallest one.
    All of it is grouping by minimum and joining, which a hub with any number of edges does not hold up. The
    edges of each round are written out; rounds end when a round changes nothing.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # from the larger end only
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        joined = both.join(low, "a")
        if larger:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(
                low.select("a", F.col("low").alias("b"))
            )
        return out.where("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, state(edges)
    while before != now and now[0]:
        # A round has no more edges than the last one, whose number says how many files it needs.
        files = now[0] // EDGES_PER_FILE + 1
        edges = cut_lineage(star(star(edges, larger=True), larger=False).coalesce(files))
        before, now = now, state(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``fingerprint`` and ``component_id`` of each document."""
    prints = cut_lineage(fingerprints(docs, key, text))
    nodes = prints.groupBy("fingerprint").agg(F.min(key).alias("first"))
    linked = components(links(nodes.select("fingerprint"))).select(F.col("node").alias("fingerprint"), "root")
    rooted = nodes.join(linked, "fingerprint")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of_linked = rooted.select("fingerprint", "root").join(smallest, "root").select("fingerprint", "component")
    of_all = nodes.join(of_linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "first").alias("component_id")
    )
    return prints.join(of_all, "fingerprint").select(key, "fingerprint", "component_id")
