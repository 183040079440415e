"""Top-k search over blocks of postings that carry the largest score they can give.

A row is one token of an entry's path: the path's text from that token on, the whole text, and ``top``, the weight of all the
entry's tokens with the same first letter. No phrase that starts like this row can weigh more in this entry, so ``top`` and the
document length bound its score. Rows lie in order of that bound, coarsely, and of the suffix within; every ``2**BLOCK_BITS`` of them are
a block, and a small table keeps each block's first and last suffix, largest ``top`` and smallest length.

A search looks up its phrases' blocks there, reads those with the largest bounds first, and stops as soon as the last hit of the
page is better than anything that the blocks left can hold. It reads whole paths' texts, so any phrases are counted from one row.

How many entries hold a phrase comes from the blocks, too. A row's ``shared`` is the length of what its suffix has in common with
the entry's previous one, in order; of an entry's rows in the range of a phrase exactly one shares less than
the phrase. Blocks keep the number of rows by that length; only blocks at the ends of a range are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.functions.text import parse_query, token_count
from archidex.operators.postings import sorting_tasks
from archidex.operators.search import (
    K1, NAME_WEIGHT, PATH_WEIGHT, _fetched, _frequency, _idf, _merit, _no_hits, _order, _scored, _term_score, _with_text,
)
from archidex.schema import Catalog, bounded
from archidex.session import cut_lineage, shuffles_freed

TIERS = 32
BLOCK_BITS = 12
LONGEST_SHARED = 32
FIRST_BLOCKS = 4
LISTED_BLOCKS = 4096  # more blocks than that are not named one by one but read as a whole range


@dataclass(frozen=True)
class ImpactIndex:
    """Rows, their blocks, and the corpus figures of the catalog they were built from."""

    rows: DataFrame
    blocks: DataFrame
    documents: float
    mean: float


def _suffixes() -> Column:
    """The entry's suffixes in order, with the weight of their tokens."""
    weight = lambda k: F.when(k <= F.col("name_tokens"), NAME_WEIGHT + PATH_WEIGHT).otherwise(PATH_WEIGHT)
    text = lambda k: F.call_function("substring_index", F.col("path_text"), F.lit(" "), -k)
    return F.array_sort(F.transform(F.sequence(F.lit(1), "path_tokens"), lambda k: F.struct(text(k).alias("suffix"), weight(k).alias("weight"))))


def _shared(suffix: Column, previous: Column) -> Column:
    """Length of the common beginning, up to ``LONGEST_SHARED``."""
    same = F.filter(F.sequence(F.lit(1), F.lit(LONGEST_SHARED)), lambda n: (F.left(suffix, n) == F.left(previous, n)) & (F.length(suffix) >= n))
    return F.when(previous.isNull() | (F.left(suffix, F.lit(1)) != F.left(previous, F.lit(1))), 0).otherwise(F.size(same))


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    """The table of blocks of that many rows.

    Least and greatest texts are found by sorting. Whole blocks are dealt to as many tasks as sorted the rows, since a task that
    reads the small files they were written to would sort all of a split, and a split holds millions of rows.
    """
    fresh = F.array(*(F.count_if(F.col("shared") < n) for n in range(1, LONGEST_SHARED + 1))).alias("fresh")
    dealt = rows.select("block", "suffix", "top", "length", "shared").repartition(sorting_tasks(count), "block")
    return dealt.groupBy("block").agg(
        F.min("suffix").alias("first"), F.max("suffix").alias("last"), F.max("top").alias("top"), F.min("length").alias("length"), fresh
    )


def build(catalog: Catalog, path: str) -> ImpactIndex:
    """Write the index of all entries of the catalog to ``path`` and open it.

    The number of tasks that sort it follows its rows. Left to the shuffle's bytes, which repeated words make few, a task's rows
    would grow with the catalog.
    """
    texts = _with_text(catalog.entries.select("snapshot_id", F.col("id").alias("entry_id"), "name", "path"))
    counted = texts.withColumns({"name_tokens": token_count(F.col("name_text")), "path_tokens": token_count(F.col("path_text"))})
    known = counted.agg(
        F.count(F.lit(1)).cast("double").alias("documents"), F.avg("length").alias("mean"), F.sum("path_tokens").alias("rows")
    ).head()
    mean = known["mean"] or 1.0
    figures = catalog.spark.range(0, 1, 1, 1).select(F.lit(known["documents"]).alias("documents"), F.lit(known["mean"]).cast("double").alias("mean"))
    counted = counted.where("path_tokens > 0").withColumn("suffixes", _suffixes())
    rows = counted.select("snapshot_id", "entry_id", "name", "name_text", "path_text", "length", "suffixes", F.posexplode("suffixes").alias("at", "one"))
    first = F.left(F.col("one.suffix"), F.lit(1))
    alike = F.filter("suffixes", lambda s: F.left(s["suffix"], F.lit(1)) == first)
    rows = rows.select(
        F.col("one.suffix").alias("suffix"), "snapshot_id", "entry_id", "name", "name_text", "path_text", "length",
        F.aggregate(alike, F.lit(0.0), lambda total, s: total + s["weight"]).alias("top"),
        _shared(F.col("one.suffix"), F.get("suffixes", F.col("at") - 1)["suffix"]).alias("shared"),
    )
    bound = _term_score(F.lit(1.0), F.col("top"), F.col("length"), F.lit(mean))
    rows = rows.withColumn("tier", (-F.floor(bound / (K1 + 1.0) * TIERS)).cast("int"))
    order = ["tier", "suffix", "snapshot_id", "entry_id"]
    laid = rows.repartitionByRange(sorting_tasks(known["rows"] or 0), *order).sortWithinPartitions(*order)
    laid = laid.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    # Small pages and row groups, so that the reader skips what a block does not need.
    with shuffles_freed(catalog.spark):
        laid.write.option("parquet.block.size", 8 << 20).option("parquet.page.row.count.limit", 1 << BLOCK_BITS).parquet(f"{path}/rows")
    stored = catalog.spark.read.parquet(f"{path}/rows")
    # Written first: the layout by text would make the table twice, once to sample it.
    blocks = cut_lineage(_blocks(stored, known["rows"] or 0))
    blocks.repartitionByRange("first").sortWithinPartitions("first").write.parquet(f"{path}/blocks")
    figures.write.parquet(f"{path}/figures")
    return open_index(catalog.spark, path)


def open_index(spark: SparkSession, path: str) -> ImpactIndex:
    figures = spark.read.parquet(f"{path}/figures").head()
    rows, blocks = (spark.read.parquet(f"{path}/{name}") for name in ("rows", "blocks"))
    return ImpactIndex(rows, blocks, figures["documents"], figures["mean"] or 1.0)


def _overlapping(index: ImpactIndex, phrase: str) -> DataFrame:
    starts = F.startswith(F.col("first"), F.lit(phrase))
    return index.blocks.where((F.col("last") >= phrase) & ((F.col("first") <= phrase) | starts))


def _in_blocks(index: ImpactIndex, blocks: DataFrame) -> DataFrame:
    """The rows of the given blocks; few blocks are named to the reader, which skips the others."""
    listed = [r["block"] for r in blocks.select("block").limit(LISTED_BLOCKS + 1).collect()]
    if len(listed) <= LISTED_BLOCKS:
        return index.rows.where(F.col("block").isin(listed)) if listed else index.rows.where(F.lit(False))
    return index.rows.join(blocks.select("block"), "block", "left_semi")


def _of_phrase(rows: DataFrame, phrase: str) -> DataFrame:
    """One row of every entry in ``rows`` that holds the phrase."""
    rows = rows.where(F.startswith(F.col("suffix"), F.lit(phrase)))
    if len(phrase) <= LONGEST_SHARED:
        return rows.where(F.col("shared") < len(phrase))
    return rows.dropDuplicates(["snapshot_id", "entry_id"])


def containing(index: ImpactIndex, phrase: str) -> int:
    """How many entries hold the phrase."""
    blocks = _overlapping(index, phrase)
    starts = lambda c: F.startswith(F.col(c), F.lit(phrase))
    whole = starts("first") & starts("last") & F.lit(len(phrase) <= LONGEST_SHARED)
    inside = blocks.where(whole).agg(F.sum(F.get("fresh", F.lit(min(len(phrase), LONGEST_SHARED) - 1)))).head()[0] or 0
    return inside + _of_phrase(_in_blocks(index, blocks.where(~whole)), phrase).count()


def search_topk_counted(
    catalog: Catalog, index: ImpactIndex, query: str, drive_id: str | None = None, limit: int | None = None
) -> tuple[DataFrame, int, int]:
    """A page of the best hits as ``search_all`` orders them, the number of blocks read for it, and that of blocks with the rarest phrase."""
    limit = bounded("search", limit)
    parsed = parse_query(query)
    phrases = [" ".join(p) for p in parsed or []]
    counts = {p: containing(index, p) for p in dict.fromkeys(phrases)}
    if not phrases or not all(counts.values()):
        return _no_hits(catalog), 0, 0
    lead = min(counts, key=lambda p: (counts[p], p))
    number, mean = F.lit(index.documents), F.lit(index.mean)
    figures = F.struct(
        number.alias("documents"), mean.alias("mean"), *(F.lit(float(counts[p])).alias(f"n{i}") for i, p in enumerate(phrases))
    )

    def most(phrase: str) -> Column:
        return _term_score(_idf(number, F.lit(float(counts[phrase]))), F.col("top"), F.col("length"), mean)

    others = sum(_overlapping(index, p).agg(F.max(most(p))).head()[0] for p in phrases if p != lead)
    bounds = _overlapping(index, lead).select("block", (most(lead) * phrases.count(lead) + others).alias("bound"))
    in_order = bounds.orderBy(F.col("bound").desc(), "block")
    total = bounds.count()
    current = catalog.current_drives(drive_id).select(F.col("latest_snapshot_id").alias("snapshot_id"))
    frequencies = {f"f{i}": _frequency(p) for i, p in enumerate(parsed)}
    merit = F.struct(*[c.alias(f"m{i}") for i, c in enumerate(_merit())])

    blocks = min(FIRST_BLOCKS, total)
    while True:
        chosen = bounds if blocks >= total else in_order.limit(blocks)
        rows = _of_phrase(_in_blocks(index, chosen), lead).withColumns(frequencies)
        hits = _scored(rows, len(phrases), figures).join(catalog.small_drives(current), "snapshot_id", "left_semi")
        page = hits.orderBy(*_merit()).limit(limit).agg(F.count("*").alias("n"), F.max(merit).alias("last")).head()
        if blocks >= total:
            break
        # Scores are negative, the best smallest; a hit as good as the page's last one, to nine digits, belongs to it.
        after = in_order.offset(blocks).limit(1).head()["bound"]
        if page["n"] == limit and -page["last"]["m0"] > after + 1e-8:
            break
        blocks = min(total, blocks * 4 if blocks * 4 <= LISTED_BLOCKS else total)
    if not page["n"]:
        return _no_hits(catalog), blocks, total
    last = F.struct(*(F.lit(v).alias(f"m{i}") for i, v in enumerate(page["last"])))
    return _fetched(catalog, hits.where(merit <= last), drive_id).orderBy(*_order()).limit(limit), blocks, total


def search_topk(
    catalog: Catalog, index: ImpactIndex, query: str, drive_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """A page of the best hits, the head of ``search_all``, from as few blocks as their bounds allow."""
    return search_topk_counted(catalog, index, query, drive_id, limit)[0]
