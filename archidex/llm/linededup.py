"""Repeated lines, found by a tree of line templates: token count, leading tokens, then the tokens most lines share.

A line's white space is made single blanks and every token with a digit a wildcard. Lines of at least ``LEAST_TOKENS`` tokens go down a tree
of fixed depth: first by their number of tokens, then by their ``LEADING`` first tokens. In a leaf that lines of several
documents reach, the template keeps at each place the token that more than half of the leaf's lines have there and a
wildcard elsewhere; a line belongs to it if at least ``FIT`` of its tokens after the leading ones agree with it. Any other line is its
own template. Of a template that occurs in several documents only the first document (smallest id) keeps its lines, all
others lose theirs; lines that repeat within one document alone stay.

DataFrame functions only. Small keys (hashes and line numbers) are shuffled and written; the texts themselves
move where lines meet the leaves that are left, and where documents meet their list of dropped lines.

Defined results: a null text stays null and an emptied one is the empty string; blank and shorter lines always stay; rows
that repeat id and text are one document and all treated alike, rows that share only the id, or have a null id, are different
documents; among equal ids the smaller text hash is first. Documents without such lines, and all other columns, are unchanged, but for
columns named n_lines and n_dropped, which the counts replace.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.session import cut_lineage

LEAST_TOKENS = 3
LEADING = 3
FIT = 0.7
WILDCARD = "<*>"


def _even(line: Column) -> Column:
    """The line with single blanks. Most lines have no others, which a plain search tells faster than a pattern."""
    uneven = reduce(Column.__or__, (F.contains(line, F.lit(blank)) for blank in ("  ", "\t", "\r", "\f", "\x0b")))
    return F.trim(F.when(uneven, F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")).otherwise(line))


def _masked(line: Column) -> Column:
    """The line with a wildcard for every token with a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", WILDCARD)).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """id, copy, place, tokens, leaf and masked text of every line that is long enough.

    Lines are masked inside the array, before it is exploded: a filter on what
    follows can't be moved below that, so each line is masked once.
    """
    masked = F.transform(F.transform(F.split("text", "\n"), _even), _masked)
    lines = docs.select("id", "copy", F.posexplode(masked).alias("place", "masked"))
    tokens = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(tokens, F.substring_index("masked", " ", LEADING))
    return lines.withColumns({"tokens": tokens, "leaf": leaf}).where(F.col("tokens") >= LEAST_TOKENS)


def _in_several(rows: DataFrame, key: str) -> DataFrame:
    """The keys that rows of different documents have, with the first document and whether their lines differ."""
    document = F.struct("id", "copy")
    varied = (F.min("line") != F.max("line")).alias("varied")
    ends = rows.groupBy(key).agg(F.min(document).alias("first"), F.max(document).alias("last"), varied)
    return ends.where(F.col("first") != F.col("last")).select(key, "first", "varied")


def _templates(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf and line (hash) of the lines that belong to the common template of their leaf, for the given leaves."""
    distinct = lines.join(leaves, "leaf", "left_semi").groupBy("leaf", "tokens", "masked").agg(F.count("*").alias("weight"))
    distinct = cut_lineage(distinct)
    varied = distinct.join(distinct.groupBy("leaf").agg(F.sum("weight").alias("total")), "leaf")
    tokens = varied.select(
        "leaf", "tokens", "total", "weight", F.xxhash64("masked").alias("line"),
        F.posexplode(F.split("masked", " ")).alias("at", "token"),
    ).where(F.col("at") >= LEADING)
    shared = tokens.groupBy("leaf", "at", "token", "total").agg(F.sum("weight").alias("weight"))
    shared = shared.where(F.col("weight") * 2 > F.col("total")).select("leaf", "at", "token")
    agreeing = tokens.join(shared, ["leaf", "at", "token"]).groupBy("leaf", "line", "tokens").agg(F.count("*").alias("same"))
    return agreeing.where(F.col("same") >= FIT * (F.col("tokens") - LEADING)).select("leaf", "line")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """id, copy and place of every line to drop, for documents with id, copy and text."""
    lines = _lines(docs)
    keys = cut_lineage(lines.select("id", "copy", "place", "leaf", F.xxhash64("masked").alias("line")))
    leaves = cut_lineage(_in_several(keys, "leaf").select("leaf", "varied"))
    # A leaf with one distinct line needs no generalising.
    common = _templates(lines, leaves.where("varied")).withColumn("common", F.lit(True))
    reached = keys.join(leaves, "leaf", "left_semi").join(common, ["leaf", "line"], "left")
    template = F.when(F.col("common"), F.xxhash64(F.lit("leaf"), "leaf")).otherwise(F.xxhash64(F.lit("line"), "line"))
    reached = reached.select("id", "copy", "place", "line", template.alias("template"))
    repeated = _in_several(reached, "template").select("template", "first")
    return reached.join(repeated, "template").where(F.struct("id", "copy") != F.col("first")).select("id", "copy", "place")


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents and columns, the text without the dropped lines, plus ``n_lines`` and ``n_dropped``."""
    copy = F.xxhash64(text)
    known = docs.select(F.col(key).alias("id"), copy.alias("copy"), F.col(text).alias("text"))
    drops = dropped_lines(known)
    # Marks up to the last dropped line, built from the gaps before each, so that long documents take linear time.
    # A set, because repeated rows name the same line more than once.
    places = drops.groupBy("id", "copy").agg(F.sort_array(F.collect_set("place")).alias("places"))
    before = F.slice(F.concat(F.array(F.lit(-1)), "places"), F.lit(1), F.size("places"))
    one = F.zip_with("places", before, lambda at, last: F.concat(F.array_repeat(F.lit(False), at - last - 1), F.array(F.lit(True))))
    marks = places.select("id", "copy", F.flatten(one).alias("_marks"), F.size("places").cast("long").alias("_dropped"))
    # The given row travels as one column, so none of its names can clash with these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), copy.alias("hash"))
    own, old = F.col("row")[key], F.col("row")[text]
    joined = rows.join(marks, own.eqNullSafe(F.col("id")) & (F.col("hash") == F.col("copy")), "left")
    kept = F.filter(F.split(old, "\n"), lambda line, i: ~F.coalesce(F.get("_marks", i), F.lit(False)))
    shorter = F.when(F.col("_marks").isNotNull(), F.array_join(kept, "\n")).otherwise(old)
    counts = {
        "n_lines": F.coalesce(F.length(old) - F.length(F.replace(old, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"),
        "n_dropped": F.coalesce("_dropped", F.lit(0)),
    }
    columns = [(shorter if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c not in counts]
    return joined.select(*columns, *(value.alias(name) for name, value in counts.items()))
