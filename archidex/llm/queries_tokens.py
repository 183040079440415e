"""Queries over whole texts by tokenizers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.llm import bpe, langid, lm, resampling, token_counts, unigram
from archidex.llm.common import table


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    vocabulary = bpe.load_vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    pieces = token_counts.load_pieces(path or public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, pieces, unigram.fit(docs, pieces))


def training_part(key: Column, folds: int, held_out: int) -> Column:
    """Whether a document teaches: crc32 of its id as text, a null id as the empty one."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds != held_out


def op7_langid(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    pieces = token_counts.load_pieces(path or public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    taught = training_part(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(taught), pieces)
    found = docs.select("doc_id", (~taught).alias("held_out"), langid.predicted(model, docs).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm.scores(docs, training_part(F.col("doc_id"), 5, 1))
    return scored.select("doc_id", (~F.col("taught")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP13_SQL = r"""
with crc as materialized (
    select list_transform(range(256), lambda i: list_reduce(
        range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(i as bigint))) as steps
), docs as (
    select row_number() over () as n, doc_id, text from documents
), pattern as (
    select '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' as p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as upper, 'abcdefghijklmnopqrstuvwxyz' as small
), source as materialized (
    select n, unnest(regexp_extract_all(translate(coalesce(text, ''), upper, small), p)) as word from docs, pattern
), target as materialized (
    select unnest(regexp_extract_all(translate(coalesce(text, ''), upper, small), p)) as word from benchmark, pattern
), vocabulary as (
    select word, hex(encode(word)) as bytes from (select word from source union select word from target)
), placed as materialized (
    select word, xor(4294967295, list_reduce(
        list_transform(range(len(bytes) // 2), lambda i: cast('0x' || bytes[2 * i + 1 : 2 * i + 2] as bigint)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), cast(4294967295 as bigint))) % 10000 as bucket
    from vocabulary, crc
), s as (
    select bucket, count(*) as n from source join placed using (word) group by bucket
), t as (
    select bucket, count(*) as n from target join placed using (word) group by bucket
), gains as materialized (
    select b.bucket, floor(1000 * ln(
        cast(coalesce(t.n, 0) + 1 as double) * cast((select count(*) from source) + 10000 as double)
        / (cast(coalesce(s.n, 0) + 1 as double) * cast((select count(*) from target) + 10000 as double)))) as gain
    from (select unnest(range(10000)) as bucket) b left join s on s.bucket = b.bucket left join t on t.bucket = b.bucket
), weighed as (
    select n, count(*) as n_features, cast(sum(gain) as bigint) as weight
    from source join placed using (word) join gains using (bucket) group by n
), scored as (
    select d.n, d.doc_id, coalesce(w.n_features, 0) as n_features, coalesce(w.weight, 0) as weight,
           cast('0x' || sha256('2024:' || coalesce(cast(d.doc_id as varchar), ''))[1:8] as bigint) as h
    from docs d left join weighed w on d.n = w.n
), noisy as (
    select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from scored
), ranked as (
    select n, row_number() over (order by score desc, doc_id nulls first) as rank from noisy where n_features >= 20
)
select doc_id, n_features, weight, score,
       case when rank <= (select count(*) * 10 // 100 from ranked) then rank end as rank
from noisy left join ranked using (n)
"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
