"""Proof of exact duplicates in a folder tree that reads as little as it can.

Three stages, each fed by what the one before could not decide:

1. size: a file of a size that no other file has is never opened;
2. quick: of the others the length, the first and the last sample are hashed; a file that these samples cover whole gets
   its full hash from the same bytes and is done;
3. full: only larger files that share size and quick hash with another are read from end to end.

Two files are in one duplicate group exactly if hashing everything would put them there. Each stage is written before the
next one begins, so a lost executor repeats its own files and none of an earlier stage. Sizes and quick hashes are counted
before they are shuffled; what comes back to the files has one row per value.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.functions.fingerprints import FULL, QUICK, QUICK_SAMPLE
from archidex.session import cut_lineage
from archidex.sources.inventory import READ_BYTES, file_inventory

CHANGED = "changed while it was read"
_READ = "path string, size long, quick_hash string, hash string, bytes_read long, error string"


def read_samples(path: str, size: int) -> tuple[str, str | None, int]:
    """Quick hash, the full hash where the samples are the whole file, and the bytes read."""
    with open(path, "rb") as file:
        if os.fstat(file.fileno()).st_size != size:
            raise OSError(CHANGED)
        head = file.read(min(size, QUICK_SAMPLE))
        tail = b""
        if size > QUICK_SAMPLE:
            file.seek(max(size - QUICK_SAMPLE, QUICK_SAMPLE))
            tail = file.read(QUICK_SAMPLE)
    if len(head) + len(tail) != min(size, 2 * QUICK_SAMPLE):
        raise OSError(CHANGED)
    quick = QUICK + hashlib.sha256(size.to_bytes(8, "little") + head + tail).hexdigest()
    full = FULL + hashlib.sha256(head + tail).hexdigest() if size <= 2 * QUICK_SAMPLE else None
    return quick, full, len(head) + len(tail)


def read_whole(path: str, size: int) -> tuple[None, str, int]:
    """No quick hash, the full hash, and the bytes read; memory is one block."""
    hasher, read = hashlib.sha256(), 0
    with open(path, "rb") as file:
        while block := file.read(READ_BYTES):
            hasher.update(block)
            read += len(block)
    if read != size:
        raise OSError(CHANGED)
    return None, FULL + hasher.hexdigest(), read


def _reader(root: str, read: Callable[[str, int], tuple]) -> Callable:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["size"], strict=True):
                try:
                    rows.append((path, size, *read(os.path.join(root, path), int(size)), None))
                except OSError as problem:
                    rows.append((path, size, None, None, 0, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "size", "quick_hash", "hash", "bytes_read", "error"])

    return run


def _shared(files: DataFrame, *keys: str) -> DataFrame:
    """Values of the keys that more than one file has."""
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def staged_fingerprints(spark: SparkSession, root: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Every file below ``root`` with ``path``, ``size``, ``stage``, ``quick_hash``, ``hash``, ``bytes_read``, ``error``.

    ``stage`` names the last stage a file came to. ``hash`` is the full hash of every file that may have a copy, and null
    where size or samples already prove that there is none. A file that can't be read, or whose length is not the listed
    one any more, has an error, no hash, and is in no group; what could not be listed has an error and a null stage.
    """
    root = os.path.abspath(root.removeprefix("file://"))
    found = file_inventory(spark, root, exclude)
    unlisted = found.where("kind = ''").select("path", F.lit(None).cast("long").alias("size"), "error")
    listed = found.where("kind = 'file'").select("path", "size")

    # Spread by path, so that files of one size, however many, are read by all tasks.
    opened = listed.join(_shared(listed, "size"), "size", "left_semi").select("path", "size").repartition("path")
    sampled = cut_lineage(opened.mapInPandas(_reader(root, read_samples), _READ))

    open_question = sampled.where("hash is null and error is null")
    unsure = open_question.join(_shared(open_question, "size", "quick_hash"), ["size", "quick_hash"], "left_semi")
    whole = unsure.select("path", "size").repartition("path").mapInPandas(_reader(root, read_whole), _READ)
    whole = cut_lineage(whole.withColumnRenamed("bytes_read", "more").withColumnRenamed("error", "failure"))

    after = sampled.join(whole.select("path", F.col("hash").alias("proof"), "more", "failure"), "path", "left")
    read = after.select(
        "path", "size", F.when(F.col("more").isNull(), "quick").otherwise("full").alias("stage"), "quick_hash",
        F.coalesce("hash", "proof").alias("hash"),
        (F.col("bytes_read") + F.coalesce("more", F.lit(0))).alias("bytes_read"), F.coalesce("error", "failure").alias("error"),
    )
    alone = listed.join(sampled.select("path"), "path", "left_anti").withColumns({
        "stage": F.lit("size"), "bytes_read": F.lit(0).cast("long"),
    })
    rest = alone.unionByName(unlisted.withColumn("bytes_read", F.lit(0).cast("long")), allowMissingColumns=True)
    return read.unionByName(rest, allowMissingColumns=True)


def staged_duplicates(files: DataFrame) -> DataFrame:
    """Every member of every group of equal (hash, size): hash, size, copies, path, in no order."""
    hashed = files.where("hash is not null")
    groups = hashed.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(groups, ["hash", "size"]).select("hash", "size", "copies", "path")


def reading_report(files: DataFrame) -> DataFrame:
    """One row per stage: files that ended there, their bytes, the bytes read of them, and errors."""
    return files.where("stage is not null").groupBy("stage").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("bytes_read").alias("bytes_read"),
        F.count("error").alias("errors"),
    )
