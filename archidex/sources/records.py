"""Records of CSV files whose quoted fields may hold line breaks, read in splits.

Whether a split begins inside a quoted field is known only from what lies
before it. Each split therefore first reports where it ends for either
beginning; the reports, composed along their file, say how each begins. A
second pass then cuts the records, and the pieces of a record that lies in
several splits are put together. Only one row per split is ever shuffled, and
the pieces of records at split borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archidex.schema import BROADCAST_ROWS
from archidex.session import cut_lineage

# A quote opens a field only at its start; behind a closed field all is plain up to the next comma.
_QUOTED = r'"[^"]*(?:""[^"]*)*'
_PLAIN = r'(?:[^",][^,]*)?'
_FIELD = rf'(?:{_QUOTED}"{_PLAIN}|{_PLAIN})'
_OPENS_OUTSIDE = rf"^(?:{_FIELD},)*{_QUOTED}$"
_OPENS_INSIDE = rf'^[^"]*(?:""[^"]*)*(?:"{_PLAIN},(?:{_FIELD},)*{_QUOTED})?$'

_ENDS = "file string, block long, if_outside boolean, if_inside boolean, breaks boolean"
_PIECES = "file string, block long, owner long, header boolean, text binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces of a split's lines in order, as (batch slice, open if outside before, open if inside before)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        files = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
        lines = batch.column("value")
        outside, inside = (
            pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(bool)
            for pattern in (_OPENS_OUTSIDE, _OPENS_INSIDE)
        )
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, stop - start), outside[start:stop], inside[start:stop]


def _states(outside: np.ndarray, inside: np.ndarray, entered: bool) -> np.ndarray:
    """Whether a field is open before each line, and after the last one.

    A line either sets the state, keeps it or exchanges it: what counts is the
    last line that set it and the exchanges since.
    """
    places = np.arange(1, len(outside) + 1)
    last_set = np.concatenate([[0], np.maximum.accumulate(np.where(outside == inside, places, 0))])
    exchanges = np.concatenate([[0], np.cumsum(outside & ~inside)])
    return np.concatenate([[entered], outside])[last_set] ^ ((exchanges - exchanges[last_set]) % 2 == 1)


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: a field open at its end for both beginnings, and if a record begins in it when entered inside."""
    split, ends, breaks = None, (False, True), False
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), *[(n, pa.bool_()) for n in ("if_outside", "if_inside", "breaks")]])

    def report() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*split, *ends, breaks)))], schema=schema)

    for lines, outside, inside in _runs(batches):
        here = (lines.column("file")[0].as_py(), lines.column("block")[0].as_py())
        if here != split:
            if split is not None:
                yield report()
            split, ends, breaks = here, (False, True), False
        entered_inside = _states(outside, inside, ends[1])
        breaks = breaks or not entered_inside[:-1].all()
        ends = (bool(_states(outside, inside, ends[0])[-1]), bool(entered_inside[-1]))
    if split is not None:
        yield report()


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split; those without an owner are whole, others are pieces of a record begun in split ``owner``."""
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("owner", pa.int64()), ("header", pa.bool_()), ("text", pa.binary()),
    ])
    split = None
    ready: list[tuple] = []
    buffer: list[bytes] = []
    began, header, is_open, opened = True, False, False, None

    def close(unfinished: bool) -> None:
        if buffer:
            owner = opened if not began else split[1] if unfinished else None
            ready.append((*split, owner, header, b"\n".join(buffer)))
            buffer.clear()

    def batch_of_ready() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
        ready.clear()
        return made

    for lines, outside, inside in _runs(batches):
        here = (lines.column("file")[0].as_py(), lines.column("block")[0].as_py())
        if here != split:
            if split is not None:
                close(is_open)
            split = here
            is_open, opened = lines.column("entered")[0].as_py(), lines.column("opened")[0].as_py()
            if is_open is None:
                raise RuntimeError(f"{here[0]}: the splits changed between two passes")
            began, header = not is_open, not is_open and here[1] == 0
        states = _states(outside, inside, is_open)
        for line, inner in zip(lines.column("value").to_pylist(), states[:-1]):
            if not inner and buffer:
                close(False)
                began, header = True, False
            buffer.append(line.removesuffix(b"\r"))
        is_open = bool(states[-1])
        if len(ready) >= 4096:
            yield batch_of_ready()
    if split is not None:
        close(is_open)
    if ready:
        yield batch_of_ready()


def _beginnings(ends: DataFrame) -> DataFrame:
    """How each split begins: inside a field or not, and in which split the record open there began."""
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("if_outside") == F.col("if_inside")
    exchanged = F.sum((F.col("if_outside") & ~F.col("if_inside")).cast("long")).over(so_far)
    last_set = F.last(F.when(sets, F.struct(F.col("if_outside").alias("open"), "exchanged")), ignorenulls=True).over(so_far)
    odd = (F.col("exchanged") - F.coalesce(F.col("last_set.exchanged"), F.lit(0))) % 2 == 1
    return (
        ends.withColumn("exchanged", exchanged)
        .withColumn("last_set", last_set)
        .withColumn("leaves", F.coalesce(F.col("last_set.open"), F.lit(False)) != odd)
        .withColumn("entered", F.lag("leaves", 1, False).over(Window.partitionBy("file").orderBy("block")))
        .withColumn("begins", ~F.col("entered") | F.col("breaks"))
        .select("file", "block", "entered", "leaves", F.last(F.when(F.col("begins"), F.col("block")), True).over(before).alias("opened"))
    )


def quoted_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, record) of every CSV record behind the first one of each file, in no order.

    Line ends inside a field become "\\n". A quote that is never closed makes
    the rest of its file one record, as it does for a reader of whole files.
    """
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("value"),
    )
    # One row per split of the files.
    beginnings = cut_lineage(_beginnings(lines.drop("place").mapInArrow(_split_ends, _ENDS)))
    splits, crossings = beginnings.agg(F.count(F.lit(1)), F.count_if("leaves")).head()
    keys = ["file", "block"]
    if splits <= BROADCAST_ROWS:
        placed = lines.join(F.broadcast(beginnings), keys, "left")
    else:
        placed = lines.join(beginnings, keys, "left").repartition(*keys).sortWithinPartitions(*keys, "place")
    taken = ("file", "block", "value", "entered", "opened")
    whole = placed.select(*taken).mapInArrow(_cut_records, _PIECES).where(F.col("owner").isNull() & ~F.col("header"))
    records = whole.select("file", F.col("text").cast("string").alias("record"))
    if not crossings:
        return records
    # Only splits with a record over a border are cut again. An unknown split stays in, so that it is noticed.
    border = placed.where(F.coalesce(F.col("entered") | F.col("leaves"), F.lit(True))).select(*taken)
    pieces = border.mapInArrow(_cut_records, _PIECES).where(F.col("owner").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text"))))
    joined = pieces.groupBy("file", "owner").agg(
        F.array_join(F.transform(ordered, lambda piece: piece["text"]), "\n").alias("record"), F.bool_or("header").alias("header")
    )
    return records.unionAll(joined.where(~F.col("header")).select("file", "record"))
