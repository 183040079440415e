"""Importance resampling of documents towards a target distribution, by hashed runs of words.

A batch of texts is lower-cased, split and flattened by Arrow kernels; a dictionary gives every distinct word a number. Runs of
several words are pairs of a shorter run's number and the next word's, taken at shifted places; CRC-32 is computed once for each
distinct pair, going on from the CRC of the shorter run. Counts of buckets over all documents and over the target give each
bucket its gain; a document's weight is a segment sum of the gains taken at its buckets. Gumbel noise from a hash of the id turns
the highest scores into a sample without replacement. Ranks come from one range-partitioned sort: rows are numbered within each
sorted partition, and the partitions' sizes, added up, give the number to start from.

Only the table of counts is gathered: one number for each bucket. Its size is a parameter and does not grow with the data.

Defined results: null and empty texts have no words, no features and weight zero; a null id is hashed as an empty one, comes first
among ties and stays null; repeated rows count and are ranked one by one, in no set order among themselves. An empty
table gives no rows; an empty target gives every bucket the gain of a target without words. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.llm.common import sliced
from archidex.session import cut_lineage

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST_RUN = 1
BUCKETS = 10_000
SHARE = (10, 100)
LEAST_WORDS = 20
SEED = 2024
PLACE_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of the text that each is from."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN_WORDS)
    words, owners = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")  # a separator at an end of the text leaves an empty word there
    return words.filter(real), owners.filter(real).to_numpy(zero_copy_only=False)


def run_buckets(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of runs in turn: the runs' buckets and the texts they are from, in order of texts."""
    words, owners = word_lists(texts)
    coded = words.dictionary_encode()
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    run, crcs = word, np.array([zlib.crc32(w) for w in distinct], dtype=np.int64)
    yield (crcs % buckets)[run], owners
    for length in range(2, longest + 1):
        whole = owners[: max(0, len(owners) - length + 1)] == owners[length - 1 :]
        pairs = run[: len(whole)] * len(distinct) + word[length - 1 :]
        known, at = np.unique(pairs[whole], return_inverse=True)
        parts = zip(*(x.tolist() for x in np.divmod(known, max(1, len(distinct)))), strict=True)
        crcs = np.array([zlib.crc32(b" " + distinct[w], int(crcs[r])) for r, w in parts], dtype=np.int64)
        # Places without a whole run keep a number of their own, so that shifts stay aligned.
        run = np.full(len(whole), len(known), dtype=np.int64)
        run[whole] = at
        yield (crcs % buckets)[at], owners[: len(whole)][whole]


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, how often runs fall into it, for buckets that are hit. Each task hands on its totals only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for part in sliced(batches, "text"):
            for found, _ in run_buckets(part.column("text"), longest, buckets):
                totals += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(totals[hit])], ["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, from the smoothed shares of target and source."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    ratios = (float(t + 1) * float(all_source + n) / (float(s + 1) * float(all_target + n)) for s, t in pairs)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def _vector(counts: DataFrame, buckets: int) -> np.ndarray:
    vector = np.zeros(buckets, dtype=np.int64)
    for row in counts.collect():  # at most a row for each bucket
        vector[row["bucket"]] = row["n"]
    return vector


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST_RUN) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight`` of each document. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for part in sliced(batches, "text"):
            numbers = np.arange(part.num_rows + 1)
            words, features, weight = (np.zeros(part.num_rows, dtype=np.int64) for _ in range(3))
            for length, (found, owners) in enumerate(run_buckets(part.column("text"), longest, len(gain)), start=1):
                starts = np.searchsorted(owners, numbers)
                sums = np.concatenate([[0], np.cumsum(gain.take(found))])
                features += np.diff(starts)
                weight += np.diff(sums[starts])
                if length == 1:
                    words = np.diff(starts)
            columns = [part.column("key"), *map(pa.array, (words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``rank`` (from 1) in the given order, without bringing them together anywhere."""
    spark = rows.sparkSession
    laid = cut_lineage(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", PLACE_BITS)
    sizes = laid.groupBy(part.alias("_part")).count().collect()  # a row for each partition of the sort
    before, firsts = 0, []
    for number, n in sorted(tuple(r) for r in sizes):
        firsts.append((number, before))
        before += n
    first = spark.createDataFrame(firsts, "_part long, _first long").coalesce(1)
    placed = laid.withColumn("_part", part).join(F.broadcast(first), "_part")
    rank = F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return placed.withColumn("rank", rank).drop("_place", "_part", "_first")


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
    longest: int = LONGEST_RUN, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents with ``least_words`` words or more, the ``share`` with the highest scores is drawn.
    """
    source = _vector(bucket_counts(docs, text, longest, buckets), buckets)
    gain = gains(source, _vector(bucket_counts(target, target_text, longest, buckets), buckets))
    scored = weights(docs, gain, key, text, longest).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    scored = cut_lineage(scored)
    fits = F.col("n_words") >= least_words
    drawn = share[0] * scored.where(fits).count() // share[1]
    # The last place of the order keeps identical rows from meeting in one partition.
    order = F.col("score").desc(), F.col("key").asc_nulls_first(), F.monotonically_increasing_id()
    first = ranked(scored.where(fits), *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~fits).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).withColumnRenamed("key", key)
