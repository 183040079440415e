"""Product codes of vectors in whole numbers: nearest codebook entries through an integer Walsh-Hadamard transform.

Components become integers, vectors are cut into equal parts, and every part position has a codebook of its own, refined in a
few rounds of assigning and averaging. Parts and entries are padded with zeros to a power of two and transformed without scaling,
which multiplies every squared distance by that power. Squared differences are added up coefficient by coefficient in sequency
order, where the slow, usually large ones come first; an entry is given up as soon as its sum passes the whole distance of an entry
already known. All of it is integer arithmetic, so results do not depend on batches, tasks or their order.

Codebooks are the only state on the driver; their size is parts times entries times width. A task hands on one sum for each entry.

Defined results: vectors that are null, hold null or non-finite components, are empty or can't be cut into equal parts take no
part; nor do those of another length than the one with the smallest id. Fewer vectors than entries make smaller codebooks. Rows of
equal id are taken in order of their vectors; a null id comes last. Repeated rows count one by one. Integers beyond 2**62 are held
there, and errors beyond the largest long at that. Large integers are computed exactly as well, only slower. An empty table
gives no rows. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.llm.common import with_group_values
from archidex.session import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 62
LONG = (1 << 63) - 1
AT_ONCE = 4096


def integer_vectors(vectors: DataFrame, *keep: Column, vector: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """The kept columns and ``values``, the components as integers, of each usable vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite
    return vectors.where(usable).select(*keep, F.transform(vector, lambda x: F.floor(held(x))).alias("values"))


def sequency_order(n: int) -> list[int]:
    """Rows of the natural Hadamard matrix of order ``n`` by their number of sign changes."""
    bits = n.bit_length() - 1
    return [int(f"{s ^ s >> 1:0{bits}b}"[::-1], 2) if bits else 0 for s in range(n)]


def walsh(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros to a power of two, in sequency order, unscaled."""
    n = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), n), dtype=rows.dtype)
    out[:, : rows.shape[1]] = rows
    half = 1
    while half < n:
        pairs = out.reshape(len(rows), n // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), n)
        half *= 2
    return out[:, sequency_order(n)]


def _exact(width: int, *arrays: np.ndarray) -> type:
    """The kind of number that holds all sums of squared differences of transformed rows."""
    n = 1 << max(0, width - 1).bit_length()
    most = max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)
    return np.int64 if n * (2 * n * most) ** 2 < 1 << 63 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry (the smallest of equals) and squared distance to it, for each part."""
    kind = _exact(parts.shape[1], parts, entries)
    a, b = walsh(parts.astype(kind)), walsh(entries.astype(kind))
    scale = a.shape[1]
    sums = (a[:, :1] - b[None, :, 0]) ** 2
    known = ((a - b[sums.argmin(axis=1)]) ** 2).sum(axis=1)  # the whole distance of one entry
    row, entry = np.nonzero(sums <= known[:, None])
    sums = sums[row, entry]
    for k in range(1, scale):
        sums = sums + (a[row, k] - b[entry, k]) ** 2
        left = (sums <= known[row]).astype(bool)
        row, entry, sums = row[left], entry[left], sums[left]
    least = np.minimum.reduceat(sums, np.searchsorted(row, np.arange(len(a)))) if len(a) else sums
    hit = np.flatnonzero(sums == least[row])
    first = np.unique(row[hit], return_index=True)[1]
    return entry[hit[first]], least // scale


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the first row, and the integer vectors, of slices of the batch."""
    for at in range(0, batch.num_rows, AT_ONCE):
        values = batch.column("values").slice(at, AT_ONCE)
        yield at, values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, at, n and total: size and sums by component of the parts assigned to each entry."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=object)
        for batch in batches:
            for _, block in _blocks(batch):
                small = int(np.abs(block).max(initial=0)) < LARGEST // AT_ONCE
                for p in range(parts):
                    own = block[:, p * width : (p + 1) * width]
                    codes, _ = nearest(own, shared.value[p])
                    counts[p] += np.bincount(codes, minlength=entries)
                    added = np.zeros((entries, width), dtype=np.int64 if small else object)
                    np.add.at(added, codes, own.astype(added.dtype))
                    totals[p] += added
        p, e, at = (x.ravel() for x in np.indices(totals.shape))
        used = counts[p, e] > 0
        p, e, at = p[used], e[used], at[used]
        total = pa.array([Decimal(int(x)) for x in totals[p, e, at]], pa.decimal128(38, 0))
        columns = [pa.array(x.astype(np.int32)) for x in (p, e, at)] + [pa.array(counts[p, e]), total]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "at", "n", "total"])

    sums = vectors.select("values").mapInArrow(run, "part int, entry int, at int, n long, total decimal(38,0)")
    return sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of integer vectors with ``id``; all of them must be of one length."""
    starts = vectors.orderBy(F.col("id").asc_nulls_last(), "values").limit(entries).collect()
    books = np.array([r["values"] for r in starts], dtype=np.int64)
    books = books.reshape(len(starts), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for row in _sums(vectors, books).collect():  # at most a row for each number in the codebooks
            books[row["part"], row["entry"], row["at"]] = int(row["total"]) // row["n"]
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """The given rows of integer vectors with ``codes`` (entry by part) and ``error`` (squared distances, summed) in place of values."""
    parts, _, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in vectors.columns if c != "values"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, parts), dtype=np.int32), np.zeros(batch.num_rows, dtype=object)
            for at, block in _blocks(batch):
                for p in range(parts):
                    code, error = nearest(block[:, p * width : (p + 1) * width], shared.value[p])
                    codes[at : at + len(block), p] = code
                    errors[at : at + len(block)] += error.astype(object)
            ends = pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32))
            coded = pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))
            held = pa.array([min(int(e), LONG) for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), coded, held], [*kept, "codes", "error"])

    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in kept)
    return vectors.mapInArrow(run, f"{schema}, codes array<int>, error long")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``values``, the entries that the codes stand for, beside the given columns."""
    table = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in entry)) for entry in book)) for book in books))
    return coded.withColumn("values", F.flatten(F.transform("codes", lambda c, p: F.get(F.get(table, p), c))))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """key, ``label``, ``codes``, ``error`` and ``label_error`` (errors summed over the label) of each usable vector, and the codebooks."""
    whole = integer_vectors(vectors, F.col(key).alias("id"), F.col(label).alias("label"), vector=vector, parts=parts, scale=scale)
    head = whole.orderBy(F.col("id").asc_nulls_last(), "values").select(F.size("values").alias("n")).first()
    whole = whole.where(F.size("values") == (head["n"] if head else 0))
    books = fit(whole, parts, entries, rounds) if head else np.zeros((parts, 0, 0), dtype=np.int64)
    coded = cut_lineage(encode(whole, books))
    sums = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    summed = sums.select("label", "n", F.least("sum", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return with_group_values(coded, summed, "label").withColumnRenamed("id", key), books
