"""Near-duplicates by an inverted join over the coordinates of MinHash signatures, confirmed on whole shingle sets.

Equal sets are one node. A node has one minimum for each of ``COORDINATES`` hash functions; coordinates of two sets agree with a
chance of their Jaccard similarity. ``threshold`` is the largest number of agreements that a pair at the link bound reaches but
for a chance of ``MISS``. Nodes are posted under each (coordinate, value), and only values that several nodes have matter:

* prefix: a pair above the threshold has that many values in common. A node with fewer shared values has no partner; for any
  other it is enough to post it under its rarest ones, all but threshold - 1, so very common values open no lists of their own.
* stars: each list pairs its members with its hub, the member whose values are most widely shared. Agreements are counted,
  pairs below the threshold or with sets of too different sizes go, the others are confirmed on whole sets. Most groups
  of copies are connected by that, with a few pairs for each node however large a list is.
* rest: lists whose members are still in several components are compared pair by pair across components, in blocks of bounded bytes, each
  two blocks by one task. Counting skips a candidate as soon as the coordinates left can't lift it to the threshold,
  and the task drops pairs that its own confirmed links connect already.

Components are built over confirmed links only. Every link between sets that share threshold values is kept.

Defined results: words are split at ASCII white space after lower-casing A-Z; a text with fewer words than a shingle has one shingle of
them all; null, empty and blank texts have none and are linked with nothing. component_id is the smallest id reachable, null
where all ids of the component are null; such a row is its own representative. Rows of equal id are compared
by their texts like any others; repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.llm.common import sliced, with_group_values
from archidex.llm.simhash import components, shingle_digests
from archidex.session import cut_lineage

SHINGLE_WORDS = 4
SIMILARITY = (80, 100)
COORDINATES = 64
MISS = 1e-5
SEED = 7
AT_ONCE = 256  # shingles hashed at a time, so that a step's arrays stay in a core's cache
BLOCK_BYTES = 2 << 20
PAIRS_OF_HUB = 4096
COUNTED_FIRST = 24

_random = np.random.default_rng(SEED)
_MASKS = _random.integers(0, 1 << 63, size=(COORDINATES, 1), dtype=np.uint64)
_FACTORS = _random.integers(0, 1 << 63, size=(COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def match_threshold(similarity: tuple[int, int] = SIMILARITY, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Agreements that a pair of the given similarity falls short of with a chance of at most ``miss``."""
    s = similarity[0] / similarity[1]
    below, t = 0.0, 0
    while t < coordinates and (below := below + comb(coordinates, t) * s**t * (1 - s) ** (coordinates - t)) <= miss:
        t += 1
    return max(1, t)


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(np.frombuffer(shingle_digests(text, width), dtype=np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set that isn't empty, as 32 bits."""
    least = np.full(COORDINATES, (1 << 64) - 1, dtype=np.uint64)
    for a in range(0, len(hashes), AT_ONCE):
        spread = hashes[a : a + AT_ONCE] ^ _MASKS
        spread *= _FACTORS
        np.minimum(least, spread.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, copy (hash of the text), n, node (digest of the set) and signature of each document. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            sets = [shingles(t, width) for t in part.column("text").to_pylist()]
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signed = [signature(s) for s in sets if len(s)]
            ends = np.cumsum([0, *(COORDINATES * bool(len(s)) for s in sets)]).astype(np.int32)
            flat = np.concatenate(signed) if signed else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [part.column("key"), part.column("copy"), sizes, pa.array(nodes, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["key", "copy", "n", "node", "signature"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, copy long, n long, node binary, signature array<int>")


def prefixes(nodes: DataFrame, threshold: int) -> DataFrame:
    """id, hub (how widely its values are shared) and prefix (its rarest shared values) of each node that can have a partner."""
    posts = nodes.select("id", F.posexplode("signature").alias("place", "value"))
    often = posts.groupBy("place", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.join(often, ["place", "value"]).groupBy("id")
    values = F.sort_array(F.collect_list(F.struct("n", "place", "value")))  # at most a value for each coordinate
    found = shared.agg(values.alias("values"), F.sum("n").alias("hub")).where(F.size("values") >= threshold)
    return found.select("id", "hub", F.slice("values", F.lit(1), F.size("values") - (threshold - 1)).alias("prefix"))


def _lists(kept: DataFrame) -> DataFrame:
    return kept.select("id", "hub", F.explode("prefix").alias("post")).select("id", "hub", "post.place", "post.value")


def reaching(signatures: np.ndarray, one: np.ndarray, threshold: int) -> np.ndarray:
    """The rows that agree with ``one`` at ``threshold`` coordinates or more; most are skipped after the first few coordinates."""
    first = (signatures[:, :COUNTED_FIRST] == one[:COUNTED_FIRST]).sum(axis=1)
    left = np.flatnonzero(first >= threshold - (len(one) - COUNTED_FIRST))
    whole = first[left] + (signatures[left, COUNTED_FIRST:] == one[COUNTED_FIRST:]).sum(axis=1)
    return left[whole >= threshold]


def similar(a: np.ndarray, b: np.ndarray, bound: tuple[int, int]) -> bool:
    """Whether two sorted sets of distinct hashes reach the similarity, in whole numbers."""
    over, under = bound
    if under * min(len(a), len(b)) < over * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return under * both >= over * (len(a) + len(b) - both)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _agreeing(threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            same = (_matrix(batch.column("x")) == _matrix(batch.column("y"))).sum(axis=1)
            yield batch.select(["hub", "id"]).filter(pa.array(same >= threshold))

    return run


def _confirmed(bound: tuple[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = (batch.column(c).to_pylist() for c in ("x", "y"))
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), bound) for x, y in zip(xs, ys, strict=True)]
            rows = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column("hub"), rows.column("id")], ["a", "b"])

    return run


def stars(lists: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int, bound: tuple[int, int]) -> DataFrame:
    """Confirmed links ``a``, ``b`` of each list's members with its hub."""
    over, under = bound
    hubs = lists.groupBy("place", "value").agg(F.max(F.struct("hub", "id")).alias("best"), F.count("*").alias("n")).where("n > 1")
    pairs = lists.select("id", "place", "value").join(hubs.select("place", "value", F.col("best.id").alias("hub")), ["place", "value"])
    pairs = cut_lineage(pairs.where("id <> hub").select("hub", "id").distinct())
    # A hub's signature and set go to as many places as its pairs need, so that a large star is no hot key.
    pieces = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PAIRS_OF_HUB).cast("int").alias("pieces"))
    of_hub = nodes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("signature").alias("x")).join(pieces, "hub")
    of_hub = of_hub.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    dealt = pairs.join(pieces, "hub").select("hub", "id", F.expr("cast(pmod(xxhash64(id), pieces) as int)").alias("piece"))
    both = dealt.join(nodes.select("id", "n", F.col("signature").alias("y")), "id").join(of_hub, ["hub", "piece"])
    fits = under * F.least("n", "hub_n") >= over * F.greatest("n", "hub_n")
    agreeing = both.where(fits).select("hub", "id", "x", "y").mapInArrow(_agreeing(threshold), "hub long, id long")
    agreeing = cut_lineage(agreeing)
    pieces = agreeing.groupBy("hub").agg(F.ceil(F.count("*") / PAIRS_OF_HUB).cast("int").alias("pieces"))
    of_hub = sets.select(F.col("id").alias("hub"), F.col("set").alias("x")).join(pieces, "hub")
    of_hub = of_hub.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    dealt = agreeing.join(pieces, "hub").select("hub", "id", F.expr("cast(pmod(xxhash64(id), pieces) as int)").alias("piece"))
    both = dealt.join(sets.select("id", F.col("set").alias("y")), "id").join(of_hub, ["hub", "piece"])
    return both.select("hub", "id", "x", "y").mapInArrow(_confirmed(bound), "a long, b long")


def links_of(labels: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, threshold: int, bound: tuple[int, int]):
    """Confirmed links across components, by number, that connect all such pairs of different sides (of any if there is one side)."""
    labels, edges = labels.copy(), []
    one_side = sides.min() == sides.max()
    for i in range(len(labels) - 1):
        after = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
        if not one_side:
            after = after[sides[after] != sides[i]]
        for j in after[reaching(signatures[after], signatures[i], threshold)].tolist():
            if labels[i] != labels[j] and similar(sets[i], sets[j], bound):
                edges.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return edges


def _remaining(threshold: int, bound: tuple[int, int]):
    """Over rows sorted by list and pair of blocks: the links of each such group."""
    group = ["place", "value", "p", "q"]

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        ids, labels, sides = (rows.column(c).to_numpy() for c in ("id", "label", "block"))
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
        signatures = _matrix(rows.column("signature").combine_chunks())
        edges = np.array(links_of(labels, signatures, sets, sides, threshold, bound), dtype=np.int64).reshape(-1, 2)
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(ids[edges[:, 0]]), pa.array(ids[edges[:, 1]])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in group], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if last is not None and tuple(keys[a]) != last:
                    yield from settle(pa.Table.from_batches(held))
                    held = []
                last = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def remaining(lists: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int, bound: tuple[int, int]) -> DataFrame:
    """Confirmed links ``a``, ``b`` among members of lists that are in different components still."""
    posts = lists.select("id", "place", "value").join(labels, "id", "left").select(
        "id", "place", "value", F.coalesce("root", "id").alias("label")
    )
    sizes = nodes.select("id", (F.col("n") * 8 + COORDINATES * 4).alias("bytes"))
    posts = cut_lineage(posts.join(sizes, "id"))
    open_lists = posts.groupBy("place", "value").agg(
        F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low < high").select("place", "value", "blocks")
    dealt = posts.join(open_lists, ["place", "value"]).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("id", "place", "value", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    known = nodes.select("id", "signature").join(sets, "id")
    rows = pairs.join(known, "id").repartition("place", "value", "p", "q").sortWithinPartitions("place", "value", "p", "q", "id")
    rows = rows.select("place", "value", "p", "q", "block", "id", "label", "signature", "set")
    return rows.mapInArrow(_remaining(threshold, bound), "a long, b long")


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            found = pa.array([shingles(t, width).tobytes() for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), found], ["id", "set"])

    return run


def links(docs: DataFrame, nodes: DataFrame, key: str, text: str, width: int, bound: tuple[int, int]) -> DataFrame:
    """Confirmed links ``a``, ``b`` of nodes that connect all that are similar enough."""
    threshold = match_threshold(bound)
    kept = cut_lineage(prefixes(nodes, threshold))
    some = cut_lineage(nodes.join(kept.select("id"), "id", "left_semi"))
    texts = docs.select(F.col(key).alias("own"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    shown = some.select("id", "key", "copy")
    texts = texts.join(shown, F.col("own").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("copy")))
    # Repeated rows share id and text; one of them shows the set.
    sets = cut_lineage(texts.select("id", "text").dropDuplicates(["id"]).mapInArrow(_sets(width), "id long, set binary"))
    lists = _lists(kept)
    first = cut_lineage(stars(lists, some, sets, threshold, bound))
    labels = components(first).select(F.col("node").alias("id"), "root")
    return first.unionAll(remaining(lists, labels, some, sets, threshold, bound))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, bound: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """key, ``n_shingles``, ``component_id`` and ``kept`` of each document."""
    signed = cut_lineage(_signed(docs, key, text, width))
    grouped = signed.where("node is not null").groupBy("node").agg(
        F.min(F.struct("key", "copy")).alias("row"), F.min("key").alias("first"), F.min("n").alias("n"),
        F.min("signature").alias("signature"), F.count("*").alias("rows"),
    )
    # Numbers are given once, in a written table.
    nodes = grouped.select("node", "row.key", "row.copy", "first", "n", "signature", "rows", F.monotonically_increasing_id().alias("id"))
    nodes = cut_lineage(nodes)
    rooted = nodes.select("id", "first").join(components(links(docs, nodes, key, text, width, bound)).withColumnRenamed("node", "id"), "id")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of_linked = rooted.select("id", "root").join(smallest, "root").select("id", "component")
    groups = nodes.join(of_linked, "id", "left").select("node", F.col("rows").alias("n"), F.coalesce("component", "first").alias("component_id"))
    rows = signed.select("key", F.col("n").alias("n_shingles"), "node")
    found = with_group_values(rows.where("node is not null"), groups, "node").select("key", "n_shingles", "component_id")
    alone = rows.where("node is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    all_rows = found.unionByName(alone)
    return all_rows.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
