"""The pipeline's stages: each takes a table of documents and applies one operator's decisions to it.

All but the last return the columns they were given. Decisions are made row by row or by id and text together, so documents
that share an id, or have none, are judged by their own texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.llm import bpe, decontam, langid, linededup, simhash, token_counts
from archidex.llm.common import table
from archidex.session import cut_lineage

LEAST_LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language the model decides on; all others, null texts among them, go."""
    pieces = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.fit(docs, pieces)
    found = docs.select(F.struct(*docs.columns).alias("row"), langid.predicted(model, docs).alias("found"))
    sure = (F.col("found.lang_pred") != langid.UNDECIDED) & (F.col("found.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; n_chars follows the text."""
    others = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    cleaned = linededup.drop_repeated_lines(docs.select("doc_id", others, "text"))
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    values = {"text": F.col("text"), "n_chars": size}
    return cleaned.select(*(values.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the smallest id, then hash of id and text; rows without an id come last.

    Documents without a word have fingerprint zero, so one of them stays. Of identical rows one stays.
    """
    row_hash = F.xxhash64("doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), row_hash.alias("hash"))
    found = simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key", "text")
    kept = found.where("key = component_id").select("key.id", "key.hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_hash.alias("hash"))
    same = (rows["hash"] == kept["hash"]) & F.col("row.doc_id").eqNullSafe(kept["id"])
    chosen = rows.join(kept, same, "left_semi").withColumn("id", F.col("row.doc_id"))
    return chosen.dropDuplicates(["hash", "id"]).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    kept = docs
    for _, items in decontam.item_blocks(table(spark, sf_dir, "benchmark")):
        kept = kept.where(F.size(decontam.passages(kept, items)) == 0)
    return kept


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, and the text that they decode to.

    Ids are written before they are decoded, so that an executor runs one Python worker for each core and not two.
    """
    vocabulary = bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.decode(cut_lineage(bpe.encode(docs, vocabulary)), vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))
