"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.session import cut_lineage

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batches with about ``limit`` bytes of ``column`` each.

    Bounds what a Python task holds beside the batch itself. A longer text is a slice of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


_state: dict[Hashable, Any] = {}


def worker_state(key: Hashable, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, such as its memory of words.

    A worker process outlives its task and may run another operator next, so
    the state of any other key is dropped: a process holds one at a time.
    """
    if key not in _state:
        _state.clear()
        _state[key] = build()
    return _state[key]


def release_state() -> None:
    """Give back what the worker keeps, at the end of a task whose state is large beside its cost to build."""
    _state.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def gather(blob: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes ``blob[start:start + size]`` of every item, one after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    shift = np.repeat(starts.astype(np.int64) - (ends - sizes), sizes)
    return blob[shift + np.arange(len(shift))]


def text_udf(function, kind, release: bool = False):
    """A column function that runs ``function(list of texts) -> pa.Array`` over slices of the texts; null is the empty text.

    With ``release`` the worker's state goes with the task, so that idle workers hold none while other stages run.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [function(texts_of(part, "text")) for part in sliced([pa.RecordBatch.from_arrays([texts], ["text"])], "text")]
            yield pa.concat_arrays(parts) if parts else function([])
        if release:
            release_state()

    # Given as objects: the annotations of a nested function are strings in this module.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


HOT_SHARE = 1000


def with_group_values(rows: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """The rows with the other columns of ``groups``, which has one row for each value of ``on`` and its number of rows ``n``.

    Groups with more than one in ``HOT_SHARE`` of all rows, of which there are fewer than that many, are broadcast,
    so their rows are not brought together; the others are joined by shuffle. Null is a value like any other.
    """
    groups = cut_lineage(groups.withColumnRenamed(on, "_on"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    often, others = F.broadcast(groups.where(hot).drop("n")), groups.where(~hot).drop("n")
    same = F.col(on).eqNullSafe(F.col("_on"))
    rest = rows.join(F.broadcast(groups.where(hot).select("_on")), same, "left_anti").join(others, same)
    return rows.join(often, same).unionByName(rest).drop("_on")
