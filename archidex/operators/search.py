"""Ranked prefix search over names and paths of the current view.

The ranking is BM25 with the name weighted eight times the path. Document
count, document frequencies and mean length come from every stored snapshot,
also when only the current view is returned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archidex.functions.paths import nocase
from archidex.functions.text import occurrences, parse_query, token_count, token_text
from archidex.schema import BROADCAST_ROWS, Catalog, CatalogError, bounded
from archidex.session import cut_lineage

# Fixed values of the ranking.
K1 = 1.2
B = 0.75
NAME_WEIGHT = 8.0
PATH_WEIGHT = 1.0
IDF_FLOOR = 1e-6

HIT_COLUMNS = (
    "id", "snapshot_id", "path", "parent_path", "name", "extension", "kind", "size",
    "modified_at", "hash", "hidden", "drive_id", "drive_name", "location",
)
ENTRY_COLUMNS = HIT_COLUMNS[:11]
# A batch's phrases are tested by their leading characters inside the scan, up to that many distinct ones; rows are the same either way.
TESTED_KEYS = 10_000
LAST_CHAR = "\U0010ffff"  # no token holds it


def _idf(documents: Column, containing: Column) -> Column:
    value = F.ln((documents - containing + 0.5) / (containing + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(IDF_FLOOR))


def _term_score(idf: Column, frequency: Column, length: Column, mean: Column) -> Column:
    return idf * (frequency * (K1 + 1.0)) / (frequency + K1 * (1.0 - B + B * length / mean))


def _frequency(phrase: list[str]) -> Column:
    in_name = occurrences(F.col("name_text"), phrase)
    in_path = occurrences(F.col("path_text"), phrase)
    return NAME_WEIGHT * in_name + PATH_WEIGHT * in_path


def _with_text(entries: DataFrame) -> DataFrame:
    texts = entries.withColumns({"name_text": token_text(F.col("name")), "path_text": token_text(F.col("path"))})
    return texts.withColumn("length", token_count(F.col("name_text")) + token_count(F.col("path_text")))


def _scored(hits: DataFrame, phrases: int, figures: Column) -> DataFrame:
    """Hits of all phrases with their score; they carry length, name and one frequency per phrase."""
    hits = hits.where(reduce(lambda a, b: a & b, (F.col(f"f{i}") > 0 for i in range(phrases))))
    hits = hits.withColumn("figures", figures)
    corpus = F.col("figures")
    total = reduce(
        lambda a, b: a + b,
        (
            _term_score(_idf(corpus["documents"], corpus[f"n{i}"]), F.col(f"f{i}"), F.col("length"), corpus["mean"])
            for i in range(phrases)
        ),
    )
    return hits.withColumn("score", -total)


def _merit() -> list[Column]:
    """What the index knows of the order of hits. Sums of parts may differ in their last bits, which decides nothing."""
    return [F.round("score", 9), nocase(F.col("name")), F.col("name")]


def _order() -> list[Column]:
    """The order of hits, the same in every form; no two entries of the current view are equal in it."""
    return [*_merit(), F.col("path"), F.col("drive_id")]


def _containing(phrases: int) -> list[Column]:
    return [F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"n{i}") for i in range(phrases)]


def search_all(catalog: Catalog, query: str, drive_id: str | None = None, corpus: str = "all") -> DataFrame:
    """Every hit with its score, in no order, by scanning entry texts: one pass for corpus figures, one for the hits."""
    phrases = parse_query(query)
    if phrases is None:
        return _no_hits(catalog)
    frequencies = {f"f{i}": _frequency(p) for i, p in enumerate(phrases)}
    documents = catalog.entries if corpus == "all" else catalog.current_entries("name", "path")
    figures = _with_text(documents.select("name", "path")).withColumns(frequencies).agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("documents"), F.avg("length").alias("mean"), *_containing(len(phrases))
        ).alias("figures")
    )
    hits = _with_text(catalog.current_entries(*ENTRY_COLUMNS, drive_id=drive_id)).withColumns(frequencies)
    return _scored(hits, len(phrases), figures.scalar()).select(*HIT_COLUMNS, "score")


def search_scan(
    catalog: Catalog, query: str, drive_id: str | None = None, limit: int | None = None, corpus: str = "all"
) -> DataFrame:
    """A page of the best hits, by scanning entry texts."""
    return search_all(catalog, query, drive_id, corpus).orderBy(*_order()).limit(bounded("search", limit))


def _index_hits(catalog: Catalog, phrases: list[str], drive_id: str | None) -> DataFrame:
    """Every hit of the postings with its score: entry key, length, name. Each phrase is a range of the sorted suffixes."""
    _require_index(catalog)
    suffix = F.col("suffix")
    weight = _posting_weight()
    starts = [F.startswith(suffix, F.lit(p)) for p in phrases]
    entries = (
        catalog.postings.where(reduce(lambda a, b: a | b, starts))
        .groupBy("snapshot_id", "entry_id", "length", "name")
        .agg(*[F.sum(F.when(start, weight).otherwise(0.0)).alias(f"f{i}") for i, start in enumerate(starts)])
    )
    counted = entries.agg(F.struct(*_containing(len(phrases))).alias("counted")).scalar()
    totals = catalog.postings_stats.agg(F.sum("docs").cast("double").alias("docs"), F.sum("tokens").alias("tokens"))
    totals = totals.select(F.struct("docs", (F.col("tokens") / F.col("docs")).alias("mean"))).scalar()
    figures = F.struct(
        totals["docs"].alias("documents"), totals["mean"].alias("mean"),
        *[counted[f"n{i}"].alias(f"n{i}") for i in range(len(phrases))],
    )
    current = catalog.current_drives(drive_id).select(F.col("latest_snapshot_id").alias("snapshot_id"))
    hits = entries.join(catalog.small_drives(current), "snapshot_id", "left_semi")
    return _scored(hits, len(phrases), figures)


def _fetched(catalog: Catalog, hits: DataFrame, drive_id: str | None) -> DataFrame:
    keys = hits.select("snapshot_id", F.col("entry_id").alias("id"), "score")
    found = catalog.current_entries(*ENTRY_COLUMNS, drive_id=drive_id).join(keys, ["snapshot_id", "id"])
    return found.select(*HIT_COLUMNS, "score")


def search_index_all(catalog: Catalog, query: str, drive_id: str | None = None) -> DataFrame:
    """Every hit with its score, in no order, by the postings."""
    phrases = [" ".join(p) for p in parse_query(query) or []]
    if not phrases:
        return _no_hits(catalog)
    return _fetched(catalog, _index_hits(catalog, phrases, drive_id), drive_id)


def search_index(
    catalog: Catalog, query: str, drive_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """A page of the best hits, by the postings.

    The last merit of the page is found inside the index. Hits up to it, ties
    included, are fetched by their keys, and the path decides among the ties.
    """
    limit = bounded("search", limit)
    phrases = [" ".join(p) for p in parse_query(query) or []]
    if not phrases:
        return _no_hits(catalog)
    hits = _index_hits(catalog, phrases, drive_id)
    merit = F.struct(*[c.alias(f"m{i}") for i, c in enumerate(_merit())])
    last = hits.orderBy(*_merit()).limit(limit).agg(F.max(merit)).scalar()
    return _fetched(catalog, hits.where(merit <= last), drive_id).orderBy(*_order()).limit(limit)


def _posting_weight() -> Column:
    """A posting inside the name counts for the name and for the path that ends with it."""
    return F.when(F.col("in_name"), NAME_WEIGHT + PATH_WEIGHT).otherwise(PATH_WEIGHT)


def _require_index(catalog: Catalog) -> None:
    if catalog.postings is None or catalog.postings_stats is None:
        raise CatalogError("the catalog has no token index")


def _no_hits(catalog: Catalog) -> DataFrame:
    return catalog.current_entries().where(F.lit(False)).select(*HIT_COLUMNS, F.lit(0.0).alias("score"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _may_match(suffix: Column, phrases: list[str]) -> Column:
    """A cheap test that every suffix with one of the phrases passes, for the scan to skip most others."""
    keys: dict[int, set[str]] = {}
    for phrase in phrases:
        size = 1 << (len(phrase).bit_length() - 1)
        keys.setdefault(size, set()).add(phrase[:size])
    within = (suffix >= phrases[0]) & ((suffix < phrases[-1]) | F.startswith(suffix, F.lit(phrases[-1])))
    if sum(map(len, keys.values())) > TESTED_KEYS:
        return within
    return within & reduce(lambda a, b: a | b, (F.left(suffix, F.lit(n)).isin(sorted(k)) for n, k in keys.items()))


def _ranges(suffixes: list[str], phrases: list[str], known: dict[str, int]) -> Iterator[tuple[int, int, int]]:
    """Number of the phrase, first and last place (exclusive), for all phrases that begin some of the sorted suffixes."""
    first = suffixes[0]
    shorter = [known[first[:n]] for n in range(1, len(first)) if first[:n] in known]
    numbers = range(bisect_left(phrases, first), bisect_right(phrases, suffixes[-1]))
    for number in (*shorter, *numbers):
        start = bisect_left(suffixes, phrases[number])
        stop = bisect_left(suffixes, phrases[number] + LAST_CHAR, start)
        if stop > start:
            yield number, start, stop


def _merge_in_order(phrases: list[str], columns: list[str]):
    """Over index rows: number of the phrase and the given columns of each row that a phrase begins.

    The index is stored in order of suffixes, and so are the phrases: a run of rows meets only the phrases between its own first
    and last suffix, each as one range of the run.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {phrase: number for number, phrase in enumerate(phrases)}
        for batch in batches:
            column = batch.column("suffix")
            suffixes = column.to_pylist()
            # A task may read several files, each in order.
            falls = pc.less(column.slice(1), column.slice(0, max(0, len(column) - 1))).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(falls) + 1).tolist(), len(suffixes)]
            numbers, places = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for number, start, stop in _ranges(suffixes[a:b], phrases, known) if b > a else ():
                    numbers.append(np.full(stop - start, number, dtype=np.int32))
                    places.append(np.arange(a + start, a + stop))
            if places:
                rows = batch.take(pa.array(np.concatenate(places)))
                found = [pa.array(np.concatenate(numbers)), *(rows.column(c) for c in columns)]
                yield pa.RecordBatch.from_arrays(found, ["number", *columns])

    return run


def _matches(postings: DataFrame, phrases: list[str]) -> DataFrame:
    """Frequency of each phrase in each entry that has it: phrase, entry key, length, name, frequency.

    ``phrases`` is the caller's own list, distinct and in order, and goes to every task; the index stays where it is.
    """
    spark = postings.sparkSession
    columns = ["snapshot_id", "entry_id", "in_name", "length", "name"]
    kinds = ", ".join(f"{c} {postings.schema[c].dataType.simpleString()}" for c in columns)
    rows = postings.where(_may_match(F.col("suffix"), phrases)).select("suffix", *columns)
    met = rows.mapInArrow(_merge_in_order(phrases, columns), f"number int, {kinds}")
    met = met.groupBy("snapshot_id", "entry_id", "number", "length", "name").agg(F.sum(_posting_weight()).alias("frequency"))
    names = _small(spark.createDataFrame(list(enumerate(phrases)), "number int, phrase string"), len(phrases))
    return met.join(names, "number").drop("number")


def search_batch(
    catalog: Catalog, queries: Sequence[str], drive_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Hits of many queries from the postings, in one job.

    A phrase is looked up once however many queries share it. A query of
    several phrases starts from the entries of its rarest one, so a common
    word beside it costs a join and not a list of all entries. Hits are keyed
    by entry, which has no hot key, and the pick of the top hits starts
    before its shuffle.
    """
    _require_index(catalog)
    limit = bounded("search", limit)
    spark = catalog.spark
    parsed = {n: [" ".join(p) for p in parse_query(text) or []] for n, text in enumerate(queries)}
    wants = [
        (n, phrase, phrases.count(phrase), len(set(phrases)))
        for n, phrases in parsed.items() for phrase in dict.fromkeys(phrases)
    ]
    if not wants:
        none = _no_hits(catalog).withColumns({"query_no": F.lit(0), "query": F.lit(""), "rank": F.lit(0)})
        return none.select("query_no", "query", "rank", *HIT_COLUMNS, "score")
    texts = _small(spark.createDataFrame(list(enumerate(queries)), "query_no int, query string"), len(queries))
    wanted = spark.createDataFrame(wants, "query_no int, phrase string, times int, phrases int")

    matches = cut_lineage(_matches(catalog.postings, sorted({w[1] for w in wants})))
    containing = matches.groupBy("phrase").agg(F.count(F.lit(1)).alias("containing"))
    known = wanted.join(containing, "phrase")
    # Corpus figures have seen all history; the hits are the current view's.
    drives = catalog.current_drives(drive_id).select(
        F.col("latest_snapshot_id").alias("snapshot_id"), F.col("id").alias("drive_id"),
        F.col("name").alias("drive_name"), "location",
    )
    current = matches.join(catalog.small_drives(drives.select("snapshot_id")), "snapshot_id", "left_semi")
    figures = catalog.postings_stats.agg(
        F.struct(
            F.sum("docs").cast("double").alias("documents"), (F.sum("tokens") / F.sum("docs")).alias("mean")
        ).alias("figures")
    )
    entry = ["query_no", "snapshot_id", "entry_id"]
    if max(w[3] for w in wants) == 1:
        hits = current.join(_small(known, len(wants)), "phrase")
    else:
        by_rarity = Window.partitionBy("query_no").orderBy("containing", "phrase")
        lead = known.withColumn("place", F.row_number().over(by_rarity)).where(F.col("place") == 1)
        candidates = current.select("snapshot_id", "entry_id", "phrase").join(
            _small(lead.select("query_no", "phrase"), len(queries)), "phrase"
        ).drop("phrase")
        asked = candidates.join(_small(known, len(wants)), "query_no")
        hits = asked.join(current, ["snapshot_id", "entry_id", "phrase"])
    corpus = F.col("figures")
    part = F.col("times") * _term_score(
        _idf(corpus["documents"], F.col("containing").cast("double")), F.col("frequency"), F.col("length"), corpus["mean"]
    )
    scored = (
        hits.withColumn("figures", figures.scalar()).withColumn("part", part)
        .groupBy(*entry, "phrases", "name")
        .agg(F.count(F.lit(1)).alias("matched"), (-F.sum("part")).alias("score"))
        .where(F.col("matched") == F.col("phrases"))
    )
    # Ties at the end of a page come along; the path, which the index lacks, decides among them.
    best = Window.partitionBy("query_no").orderBy(*_merit())
    top = scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= limit)
    top = top.select("query_no", "snapshot_id", F.col("entry_id").alias("id"), "score")
    found = catalog.entries.select(*ENTRY_COLUMNS).join(top, ["snapshot_id", "id"])
    found = found.join(catalog.small_drives(drives), "snapshot_id")
    final = Window.partitionBy("query_no").orderBy(*_order())
    found = found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit).join(texts, "query_no")
    return found.orderBy("query_no", "rank").select("query_no", "query", "rank", *HIT_COLUMNS, "score")


def search(
    catalog: Catalog, query: str, drive_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Best hits of one query: from the token index if there is one, else by scanning, with the same rows."""
    if catalog.postings is None:
        return search_scan(catalog, query, drive_id, limit)
    return search_index(catalog, query, drive_id, limit)
