"""File inventory of a folder tree on a mount that every executor sees."""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.functions.fingerprints import FULL, QUICK, QUICK_SAMPLE
from archidex.functions.paths import base_name, extension_of, is_hidden, parent_of
from archidex.schema import CatalogError
from archidex.session import cut_lineage
from archidex.sources.globs import exclusion_regex

BATCH_ROWS = 4096
FOLDERS_PER_TASK = 2000
READ_BYTES = 1 << 20

_LISTING = "path string, kind string, size long, modified_at long, pending boolean, error string"


def _row(path, kind="", size=0, modified=0, pending=False, error=None):
    return path, kind, size, modified, pending, error


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "kind", "size", "modified_at", "pending", "error"])


def _list_folder(root: str, folder: str) -> Iterator[tuple]:
    """One row per item of a folder; an unreadable item gives an error row instead."""
    try:
        with os.scandir(os.path.join(root, folder)) as items:
            for item in items:
                path = f"{folder}/{item.name}" if folder else item.name
                try:
                    info = item.stat(follow_symlinks=False)
                except OSError as problem:
                    yield _row(path, error=str(problem))
                    continue
                if stat.S_ISLNK(info.st_mode):
                    yield _row(path, "symlink", 0, info.st_mtime_ns // 10**9)
                elif stat.S_ISDIR(info.st_mode):
                    yield _row(path, "directory", 0, info.st_mtime_ns // 10**9)
                else:
                    yield _row(path, "file", info.st_size, info.st_mtime_ns // 10**9)
    except OSError as problem:
        yield _row(folder, error=str(problem))


def _lister(root: str, budget: int, exclusion: str | None):
    """Lists folders and the ones found below them until ``budget`` folders are done.

    Excluded folders are not entered. What is left then is handed back as pending, to be spread over the
    cluster in the next round.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        listed = 0
        dropped = re.compile(exclusion).search if exclusion else lambda path: None
        for batch in batches:
            for start in batch["path"]:
                queue = [start]
                while queue:
                    folder = queue.pop()
                    if listed >= budget and folder != start:
                        rows.append(_row(folder, pending=True))
                        continue
                    listed += 1
                    for row in _list_folder(root, folder):
                        if row[0] and dropped(row[0]):
                            continue
                        rows.append(row)
                        if row[1] == "directory":
                            queue.append(row[0])
                        if len(rows) >= BATCH_ROWS:
                            yield _frame(rows)
                            rows = []
        if rows:
            yield _frame(rows)

    return run


def _digest(path: str, size: int, mode: str) -> str:
    with open(path, "rb") as file:
        if mode == "full":
            hasher = hashlib.sha256()
            while chunk := file.read(READ_BYTES):
                hasher.update(chunk)
            return FULL + hasher.hexdigest()
        hasher = hashlib.sha256(size.to_bytes(8, "little"))
        hasher.update(file.read(min(size, QUICK_SAMPLE)))
        if size > QUICK_SAMPLE:
            file.seek(max(size - QUICK_SAMPLE, QUICK_SAMPLE))
            hasher.update(file.read())
        return QUICK + hasher.hexdigest()


def _hasher(root: str, mode: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, errors = [], []
            for path, kind, size, error in zip(batch["path"], batch["kind"], batch["size"], batch["error"]):
                value = ""
                if kind == "file":
                    try:
                        value = _digest(os.path.join(root, path), int(size), mode)
                    except OSError as problem:
                        error = str(problem)
                hashes.append(value)
                errors.append(error)
            yield batch.assign(hash=hashes, error=errors)

    return run


def file_inventory(
    spark: SparkSession,
    root: str,
    exclude: Iterable[str] = (),
    hash_mode: str = "none",
    folders_per_task: int = FOLDERS_PER_TASK,
) -> DataFrame:
    """Entries below ``root`` plus rows with an ``error`` for what could not be read.

    Rows with an error and no kind are unreadable items (not entries); rows
    with an error and a kind are files whose hashing failed.
    """
    if hash_mode not in ("none", "quick", "full"):
        raise CatalogError(f"hash mode {hash_mode!r}: none, quick or full are known")
    root = os.path.abspath(root.removeprefix("file://"))
    if not os.path.isdir(root):
        raise CatalogError(f"no folder to list at {root}")
    exclusion = exclusion_regex(exclude)

    frontier = spark.createDataFrame([("",)], "path string")
    listed: DataFrame | None = None
    parallelism = spark.sparkContext.defaultParallelism
    while True:
        found = frontier.mapInPandas(_lister(root, folders_per_task, exclusion), _LISTING)
        found = cut_lineage(found)
        done = found.where(~F.col("pending"))
        listed = done if listed is None else listed.unionAll(done)
        pending = found.where("pending").select("path")
        if pending.isEmpty():
            break
        frontier = pending.repartition(max(parallelism * 4, 8))
    files = listed.drop("pending")
    if hash_mode == "none":
        files = files.withColumn("hash", F.lit(""))
    else:
        schema = "path string, kind string, size long, modified_at long, error string, hash string"
        spread = files.repartition(F.col("path"))
        files = spread.mapInPandas(_hasher(root, hash_mode), schema)
    path = F.col("path")
    is_file = F.col("kind") == "file"
    return files.select(
        "path",
        parent_of(path).alias("parent_path"),
        base_name(path).alias("name"),
        F.when(is_file, extension_of(base_name(path))).otherwise("").alias("extension"),
        "kind",
        "size",
        "modified_at",
        "hash",
        is_hidden(base_name(path)).alias("hidden"),
        "error",
    )


def inventory_entries(inventory: DataFrame) -> DataFrame:
    """The entries of an inventory, unreadable items left out."""
    return inventory.where(F.col("kind") != "").drop("error")


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """One row: files, directories, bytes, errors."""
    is_file = F.col("kind") == "file"
    return inventory.agg(
        F.count_if(is_file).alias("files"),
        F.count_if(F.col("kind") == "directory").alias("directories"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def binary_fingerprints(spark: SparkSession, paths: str | list[str], mode: str) -> DataFrame:
    """Path and fingerprint of files read as whole binary rows (up to 2 GiB each)."""
    from archidex.functions.fingerprints import full_fingerprint, quick_fingerprint

    expression = {"full": full_fingerprint, "quick": quick_fingerprint}[mode]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", F.col("length").alias("size"), expression(F.col("content")).alias("hash"))
