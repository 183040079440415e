"""Search postings of catalog entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.functions.text import token_count, token_text


# Rows of an index that one task sorts: some 300 bytes each in memory, so tasks stay the same size however large the index is.
ROWS_A_TASK = 200_000


def sorting_tasks(rows: int) -> int:
    """How many tasks sort that many rows of an index."""
    return max(1, -(-rows // ROWS_A_TASK))


def _with_tokens(entries: DataFrame) -> DataFrame:
    texts = entries.withColumns({"name_text": token_text(F.col("name")), "path_text": token_text(F.col("path"))})
    return texts.withColumns({
        "name_tokens": token_count(F.col("name_text")), "path_tokens": token_count(F.col("path_text")),
    })


def build_postings(entries: DataFrame) -> DataFrame:
    """One row per token of an entry's path: the path's text from that token on.

    A prefix phrase of any number of tokens is a prefix of the suffix, so it
    is one range of the sorted postings. The name is the end of the path, so
    a suffix that starts inside it (``in_name``) stands for an occurrence in
    both. Document length and name ride along: ranking and its tie break by
    name are settled inside the index.
    """
    path_tokens = F.col("path_tokens")
    numbered = _with_tokens(entries).where(path_tokens > 0).select(
        "snapshot_id", F.col("id").alias("entry_id"), "name", "path_text", "name_tokens",
        (F.col("name_tokens") + path_tokens).alias("length"),
        F.explode(F.sequence(F.lit(1), path_tokens)).alias("from_end"),
    )
    suffix = F.call_function("substring_index", F.col("path_text"), F.lit(" "), -F.col("from_end"))
    in_name = F.col("from_end") <= F.col("name_tokens")
    return numbered.select(
        suffix.alias("suffix"), "snapshot_id", "entry_id", in_name.alias("in_name"), "length", "name"
    )


def postings_stats(entries: DataFrame) -> DataFrame:
    """One row: documents and their total token count, names and paths together."""
    length = (F.col("name_tokens") + F.col("path_tokens")).cast("long")
    return _with_tokens(entries).agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(length), F.lit(0)).alias("tokens")
    )
