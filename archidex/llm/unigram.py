"""Unigram probabilities of vocabulary pieces, fitted to a whole corpus by expectation maximisation.

The distinct words of all documents, in chunks of bounded length, are counted once (within tasks, then by shuffle). Each
round sums over all segmentations of every distinct chunk, weighed by its count, and adds up how often each piece is expected
to be used. Only those sums, one for each piece of the fixed vocabulary, come to the driver.

Expected uses are added as whole numbers of 1/``GRAIN``, so the result does not depend on the order of tasks and a repeated
task changes nothing; sums hold up to 10**14 uses of a piece. Null and empty texts teach nothing; without words all
pieces are equally likely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.llm.common import release_state, sliced, texts_of
from archidex.llm.langid import CHUNK, Lattice, PieceTrie, chunks_of
from archidex.llm.token_counts import WORD_MARK
from archidex.session import cut_lineage

ROUNDS = 3
UNKNOWN_SHARE = 1e-7
# No piece is less likely, so that the product over a whole chunk of any corpus stays above the smallest double.
LEAST_SHARE = 1e-9
GRAIN = 1 << 16
LATTICE_CHUNKS = 8_000
HELD_WORDS = 200_000


def chunk_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct chunks of the marked words of all texts with their number: chunk, n."""

    def chunked(words: Counter) -> pa.RecordBatch:
        short = {WORD_MARK + word: n for word, n in words.items() if len(word) < CHUNK}
        counted = Counter(short) if len(short) < len(words) else short
        for word, n in words.items() if len(short) < len(words) else ():
            if len(word) >= CHUNK:
                for chunk in chunks_of(word):
                    counted[chunk] += n
        return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["chunk", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for part in sliced([batch], "text"):
                for text in texts_of(part, "text"):
                    words.update(text.split())
                if len(words) > HELD_WORDS:
                    yield chunked(words)
                    words.clear()
        yield chunked(words)

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "chunk string, n long")
    return found.groupBy("chunk").agg(F.sum("n").alias("n"))


def expected_uses(chunks: DataFrame, pieces: tuple[str, ...], weights: np.ndarray) -> np.ndarray:
    """How often each piece is used over all segmentations of all chunks; the last one is the unknown piece."""
    shared = chunks.sparkSession.sparkContext.broadcast((pieces, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weights = shared.value
        trie, used = PieceTrie(pieces), np.zeros(len(pieces) + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, LATTICE_CHUNKS):
                part = batch.slice(at, LATTICE_CHUNKS)
                lattice = Lattice(trie, part.column("chunk").to_pylist())
                used += uses(lattice, weights[:, None], part.column("n").to_numpy())
        places = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(used[places])], ["piece", "used"])
        release_state()

    sums = chunks.mapInArrow(run, "piece long, used long").groupBy("piece").agg(F.sum("used").alias("used")).toPandas()
    total = np.zeros(len(pieces) + 1)
    total[sums["piece"].to_numpy(dtype=np.int64)] = sums["used"].to_numpy(dtype=np.int64) / GRAIN
    return total


def uses(lattice: Lattice, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses in grains. A chunk's share of each place is rounded before it is multiplied by the chunk's count."""
    ahead = lattice.forward(weights)
    behind = lattice._sums(weights, lattice.ends, lattice.starts, range(int(lattice.sizes.max(initial=0)) - 1, -1, -1))
    total = ahead[np.arange(len(lattice.sizes)), lattice.sizes, 0]
    share = ahead[lattice.words, lattice.starts, 0] * weights[lattice.pieces, 0] * behind[lattice.words, lattice.ends, 0]
    grains = np.rint(share / total[lattice.words] * GRAIN).astype(np.int64) * counts[lattice.words]
    sums = np.zeros(len(weights), dtype=np.int64)
    np.add.at(sums, lattice.pieces, grains)
    return sums


def fit(docs: DataFrame, pieces: tuple[str, ...], text: str = "text") -> np.ndarray:
    """The natural logarithm of each piece's probability, in the order of ``pieces``."""
    chunks = cut_lineage(chunk_counts(docs, text))
    weights = np.full(len(pieces) + 1, 1.0 / (len(pieces) + 1))
    for _ in range(ROUNDS):
        used = expected_uses(chunks, pieces, weights)
        weights = np.maximum(used / max(used.sum(), 1.0), LEAST_SHARE)
        weights[-1] = UNKNOWN_SHARE
    return np.log(weights[:-1])
