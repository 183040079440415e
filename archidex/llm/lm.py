"""Bigram language model as a weighted automaton with failure arcs, trained and applied block by block.

The model's states are the words of the training texts, the begin of a text and the empty context, the root. A state has
an arc for each word seen after it, with the smoothed probability, and a failure arc to the root with the rest of the mass;
the root has an arc for every word, unknown ones included. One pass over a text from left to right carries the
state and adds the arcs' log10 weights. With Dirichlet smoothing of mass ``MASS``,

    P(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w | h) = (c(h w) + MASS P(w)) / (c(h) + MASS),     failure arc of h: MASS / (c(h) + MASS)

all probabilities of a context sum to one, the unknown word being one of the V + 1.

No model is ever held whole. Documents are dealt into blocks of about ``BLOCK_BYTES``. Each block sends its distinct words
and bigrams with its own counts, as sorted 64-bit hashes packed by hash range. Each range adds the counts of all blocks
and sends back, in the same order, what the other blocks have. Then a block knows all counts that its texts need,
builds the part of the automaton over its own words, and scores its texts. Every n-gram is counted; a very common one
is at most one number per block.

Defined results: a null text is empty, an empty text has the end token only; a null id is trained as the empty id would be.
Words are told apart by 64-bit hashes. Repeated rows count each time; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.llm.common import sliced, worker_state

MASS = 50.0
ADDED = 0.5
BLOCK_BYTES = 8 << 20
RANGE_KEYS = 1 << 20
CACHED_WORDS = 200_000

# No word holds white space, so these stand for no word: the end and the begin of a text.
END, BEGIN = b"\n", b" "
WORD, PAIR = 1, 2


class _Hashes(dict):
    """64-bit hashes of words: a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, then the end. Bytes split at and lower-case ASCII only."""
    return [*(text or "").encode().lower().split(), END]


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, and the texts' bounds in them."""
    values, sizes, look = [], [0], worker_state("word hashes", _Hashes).__getitem__
    for text in texts:
        values.append(np.fromiter(map(look, tokens_of(text)), dtype=np.uint64))
        sizes.append(len(values[-1]))
    return np.concatenate([np.empty(0, np.uint64), *values]), np.cumsum(sizes)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_or(right << np.uint64(31), right >> np.uint64(33))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _contexts(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash before each token; the begin mark before a text's first."""
    before = np.concatenate([np.empty(1, np.uint64), tokens[:-1]]) if len(tokens) else tokens
    before[bounds[:-1]] = xxhash.xxh3_64_intdigest(BEGIN)
    return before


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of their weights, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(weights[order], starts) if len(keys) else np.empty(0, np.int64)
    places = np.empty(len(keys), dtype=np.int64)
    places[order] = np.cumsum(first) - 1
    return ordered[starts], sums, places


class Block:
    """The tokens of a block's texts with their distinct words and bigrams and the block's own training counts."""

    def __init__(self, texts: list[str | None], taught: np.ndarray):
        self.tokens, self.bounds = hashed(texts)
        weights = np.repeat(taught.astype(np.int64), np.diff(self.bounds))
        contexts = _contexts(self.tokens, self.bounds)
        # The begin mark is counted among the words, once for each training text.
        begin = np.array([xxhash.xxh3_64_intdigest(BEGIN)], dtype=np.uint64)
        words = _counted(np.concatenate([self.tokens, begin]), np.concatenate([weights, [taught.sum()]]))
        pairs = _counted(_mixed(contexts, self.tokens), weights)
        self.own = {WORD: words[:2], PAIR: pairs[:2]}
        self.places = {WORD: words[2][:-1], PAIR: pairs[2]}
        self.begin = int(words[2][-1])

    def chunks(self, bits: int) -> Iterator[tuple[int, int, slice]]:
        """Order, hash range and place of the keys of each range."""
        for order, (keys, _) in self.own.items():
            ranges = keys >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(keys) else []
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                yield order, int(ranges[a]), slice(int(a), int(b))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of like bytes: of numbers that are alike, most planes are constant and cost nothing compressed."""
    return np.ascontiguousarray(values.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys of one range as the steps between them, which are shorter than the keys."""
    return _packed(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data).view(np.uint64), dtype=np.uint64)


def _send(bits: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        block = Block(group.column("text").to_pylist(), group.column("taught").to_numpy().astype(bool))
        rows = [
            (order, part, key[0].as_py(), _packed_keys(block.own[order][0][at]), _packed(block.own[order][1][at]))
            for order, part, at in block.chunks(bits)
        ]
        return _table(rows, [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["kind", "part", "block", "keys", "counts"])

    return run


def _table(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _add(group: pa.Table) -> pa.Table:
    """What the other blocks have counted of each block's keys of one range; nothing where that is all zero."""
    keys = [_unpacked_keys(b) for b in group.column("keys").to_pylist()]
    own = np.concatenate([_unpacked(b) for b in group.column("counts").to_pylist()])
    _, sums, places = _counted(np.concatenate(keys), own)
    others = np.split(sums[places] - own, np.cumsum([len(k) for k in keys])[:-1])
    heads = zip(*(group.column(c).to_pylist() for c in ("kind", "part", "block")), strict=True)
    rows = [(*head, _packed(x)) for head, x in zip(heads, others, strict=True) if x.any()]
    return _table(rows, [pa.int32(), pa.int64(), pa.int64(), pa.binary()], ["kind", "part", "block", "others"])


class Automaton:
    """The part of the model over one block's words. State 0 is the root, state w + 1 the context of word w."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, heads: np.ndarray, tails: np.ndarray, n: int, v: int, mass: float):
        unigram = (words + ADDED) / (n + ADDED * (v + 1))
        self.root = np.log10(unigram).tolist()
        self.fail = np.log10(mass / (words + mass)).tolist()
        self.width = len(words)
        seen = pairs > 0
        heads, tails, pairs = heads[seen], tails[seen], pairs[seen]
        weights = np.log10((pairs + mass * unigram[tails]) / (words[heads] + mass))
        self.arcs = dict(zip((heads * self.width + tails).tolist(), weights.tolist(), strict=True))

    def score(self, state: int, word_numbers: list[int]) -> float:
        """Log10 probability of the words from a state on, by one pass over them."""
        total, arcs, root, fail, width = 0.0, self.arcs.get, self.root, self.fail, self.width
        for word in word_numbers:
            weight = arcs(state * width + word)
            total += fail[state] + root[word] if weight is None else weight
            state = word
        return total


def _score(bits: int, n: int, v: int, mass: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        taught = left.column("taught").to_numpy().astype(bool)
        block = Block(left.column("text").to_pylist(), taught)
        others = {
            (order, part): _unpacked(x)
            for order, part, x in zip(*(right.column(c).to_pylist() for c in ("kind", "part", "others")), strict=True)
        }
        counts = {order: own.copy() for order, (_, own) in block.own.items()}
        for order, part, at in block.chunks(bits):
            if (order, part) in others:
                counts[order][at] += others[order, part]
        words, pairs = counts[WORD], counts[PAIR]
        numbers = block.places[WORD]
        before = np.concatenate([[0], numbers[:-1]]) if len(numbers) else numbers
        before[block.bounds[:-1]] = block.begin
        heads, tails = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        heads[block.places[PAIR]], tails[block.places[PAIR]] = before, numbers
        automaton = Automaton(words, pairs, heads, tails, n, v, mass)
        known = words[numbers]
        base = np.log10((known + ADDED) / (n + ADDED * (v + 1)))
        rows = []
        for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
            rows.append((b - a, int((known[a:b] > 0).sum()), float(base[a:b].sum()), automaton.score(block.begin, numbers[a:b].tolist())))
        found = _table(rows, [pa.int64(), pa.int64(), pa.float64(), pa.float64()], ["n_tokens", "n_known", "base_score", "score"])
        return pa.Table.from_arrays([left.column("key"), left.column("taught"), *found.columns], ["key", "taught", *found.column_names])

    return run


def _distinct_words(bits: int):
    """Distinct word hashes of each slice's training texts, packed by range, with the tokens' number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", 4 * BLOCK_BYTES):
            tokens, _ = hashed(part.column("text").to_pylist())
            block = np.unique(tokens)
            ranges = (block >> np.uint64(64 - bits)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])).tolist()
            stops = [*starts[1:], len(block)]
            counts = [len(tokens), *[0] * (len(starts) - 1)]
            columns = [ranges[starts].tolist(), [_packed_keys(block[a:b]) for a, b in zip(starts, stops, strict=True)], counts]
            types = [pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "keys", "n"])

    return run


def _count_distinct(group: pa.Table) -> pa.Table:
    keys = np.concatenate([_unpacked_keys(b) for b in group.column("keys").to_pylist()])
    return pa.table({"n": [sum(group.column("n").to_pylist())], "v": [len(np.unique(keys))]})


def scores(docs: DataFrame, taught, key: str = "doc_id", text: str = "text", mass: float = MASS) -> DataFrame:
    """key, ``taught``, n_tokens, n_known, train_tokens, base_score and score of each document.

    ``taught`` is a condition on the documents' columns: those that the model learns from.
    """
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(taught, F.lit(False)).alias("taught"))
    size = given.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    bits = max(4, math.ceil(math.log2(size / 6 / RANGE_KEYS + 1)))

    words = given.where("taught").select("text").mapInArrow(_distinct_words(bits), "part long, keys binary, n long")
    n, v = words.groupBy("part").applyInArrow(_count_distinct, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0

    dealt = given.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)))
    sent = dealt.groupBy("block").applyInArrow(_send(bits), "kind int, part long, block long, keys binary, counts binary")
    added = sent.groupBy("kind", "part").applyInArrow(_add, "kind int, part long, block long, others binary")
    kind = given.schema["key"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(
        _score(bits, n, v, mass),
        f"key {kind}, taught boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).withColumnRenamed("key", key)
