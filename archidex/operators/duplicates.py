"""Exact duplicates, proven by full-content fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.functions.fingerprints import FULL, has_scheme, packed, unpacked
from archidex.schema import Catalog, bounded
from archidex.session import scratch_path, shuffles_freed

CHUNK_FILES = 10_000
# Current files of a slice, and the most slices that groups or members are found in: each reads the entries once more.
SLICE_FILES = 1_000_000
GROUP_SLICES = 3
MEMBER_SLICES = 8


def _proven_files(catalog: Catalog, drive_id: str | None) -> DataFrame:
    files = catalog.current_entries("path", "kind", "size", "hash", drive_id=drive_id)
    return files.where((F.col("kind") == "file") & (F.col("hash") != "") & has_scheme(F.col("hash"), FULL))


def _packed_groups(files: DataFrame) -> DataFrame:
    packed_files = files.select(packed(F.col("hash")).alias("content"), "size")
    return packed_files.groupBy("content", "size").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def _groups(files: DataFrame) -> DataFrame:
    return _packed_groups(files).select(unpacked(F.col("content")).alias("hash"), "size", "copies")


def _members(files: DataFrame) -> DataFrame:
    packed_files = files.select(packed(F.col("hash")).alias("content"), "size", "drive_id", "drive_name", "path")
    members = packed_files.join(_packed_groups(files), ["content", "size"])
    return members.select(unpacked(F.col("content")).alias("hash"), "size", "copies", "drive_id", "drive_name", "path")


def _slices(catalog: Catalog, drive_id: str | None, most: int) -> int:
    """Slices of the current files by the counters of a stored catalog; one that is not stored would have to be made to be counted."""
    if catalog.location is None:
        return 1
    drives = catalog.current_drives(drive_id).select(F.col("latest_snapshot_id").alias("id"))
    files = catalog.snapshots.join(catalog.small_drives(drives), "id").agg(F.sum("file_count")).head()[0] or 0
    return max(min(-(-files // SLICE_FILES), most), 1)


def _in_slices(catalog: Catalog, drive_id: str | None, result: Callable[[DataFrame], DataFrame], slices: int) -> DataFrame:
    """``result`` of the proven files, taken in slices by fingerprint, one after the other.

    Equal fingerprints are in one slice. Each slice's result is written to the
    shared folder and its shuffle files are freed before the next begins, so
    the disk holds results and the shuffle of one slice, not that of all files.
    """
    files = _proven_files(catalog, drive_id)
    if slices == 1:
        return result(files)
    path = scratch_path(catalog.spark, "duplicates")
    parts = [f"{path}/{i}" for i in range(slices)]
    for i, part in enumerate(parts):
        some = result(files.where(F.pmod(F.xxhash64("hash"), F.lit(slices)) == i))
        with shuffles_freed(catalog.spark):
            some.write.option("compression", "zstd").parquet(part)
    return catalog.spark.read.schema(some.schema).parquet(*parts)


def duplicate_groups_all(catalog: Catalog, drive_id: str | None = None, slices: int | None = None) -> DataFrame:
    """Every group of equal (hash, size) with its copy count, in no order.

    Copies are counted before the shuffle, so a group that holds a large part
    of all files costs one row per task. Many files are taken in slices.
    """
    return _in_slices(catalog, drive_id, _groups, slices or _slices(catalog, drive_id, GROUP_SLICES))


def duplicates_all(catalog: Catalog, drive_id: str | None = None, slices: int | None = None) -> DataFrame:
    """Every member of every duplicate group, one row per file, in no order.

    The groups' side has one row per key, so a skewed join can split the
    files of a hot group over many tasks. Fingerprints are shuffled as bytes,
    which takes half of what their text does. Many files are taken in slices.
    """
    return _in_slices(catalog, drive_id, _members, slices or _slices(catalog, drive_id, MEMBER_SLICES))


def duplicate_groups(
    catalog: Catalog, drive_id: str | None = None, limit: int | None = None, slices: int | None = None
) -> DataFrame:
    """A page of the groups that hold most bytes. Of many files, each slice gives its own page first."""
    page = bounded("duplicates", limit)

    def top(groups: DataFrame) -> DataFrame:
        # Decimal: size times copies can pass the range of a long.
        held = F.col("size").cast("decimal(19,0)") * F.col("copies").cast("decimal(19,0)")
        return groups.orderBy(held.desc(), "hash", "size").limit(page)

    slices = slices or _slices(catalog, drive_id, GROUP_SLICES)
    return top(_in_slices(catalog, drive_id, lambda files: top(_groups(files)), slices))


def duplicates(catalog: Catalog, drive_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Members of the top duplicate groups, one row per file.

    At most 200 groups come back to the files, so that side is broadcast; the
    final order includes the path, which splits a large group over many tasks.
    """
    top = duplicate_groups(catalog, drive_id, limit)
    members = _proven_files(catalog, drive_id).join(F.broadcast(top), ["hash", "size"])
    return members.select("hash", "size", "copies", "drive_id", "drive_name", "path").orderBy(
        F.col("size").desc(), "hash", "drive_name", "path", "drive_id"
    )


def duplicates_nested(
    catalog: Catalog, drive_id: str | None = None, limit: int | None = None, chunk_files: int = CHUNK_FILES
) -> DataFrame:
    """Duplicate groups with nested file lists.

    A group beyond ``chunk_files`` copies continues in further rows (``chunk``
    of ``chunks``), so that no row or task holds a whole unbounded group.
    """
    members = duplicates(catalog, drive_id, limit)
    chunks = F.ceil(F.col("copies") / chunk_files).cast("int")
    placed = members.withColumns({
        "chunks": chunks,
        "chunk": F.pmod(F.xxhash64("drive_id", "path"), chunks.cast("long")).cast("int"),
    })
    file = F.struct("drive_name", "path", "drive_id")
    nested = placed.groupBy("hash", "size", "copies", "chunks", "chunk").agg(
        F.sort_array(F.collect_list(file)).alias("files")
    )
    ordered = F.transform(
        "files", lambda f: F.struct(f["drive_id"].alias("drive_id"), f["drive_name"].alias("drive_name"), f["path"].alias("path"))
    )
    return nested.withColumn("files", ordered).orderBy(F.col("size").desc(), "hash", "chunk")
