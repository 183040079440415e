"""Content identity of snapshots.

A snapshot's digest is the hash of its header and of its entries. Each entry
is hashed with all its fields; the hashes are cut into lanes and the lanes
added up, which needs no order and is done in every task before anything is
shuffled: one row per task and snapshot moves, whatever the snapshot's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.functions.fingerprints import FULL, has_scheme
from archidex.operators.validate import NUL, entry_problem
from archidex.schema import Catalog

LANES = 4  # of 64 bits each

_ENTRY_FIELDS = ("path", "parent_path", "name", "extension", "kind", "size", "modified_at", "hash", "hidden")
_HEADER_FIELDS = (
    "id", "drive_id", "source_path", "status", "hash_mode", "file_count", "directory_count", "total_bytes",
    "error_count", "started_at", "completed_at", "failure",
)


def framed(*values: Column) -> Column:
    """Values joined with their byte lengths in front, so that no two lists look alike."""
    texts = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.concat(*[part for t in texts for part in (F.octet_length(t).cast("string"), F.lit(":"), t)])


def _lane(node: Column, number: int) -> Column:
    """One lane of a hash in hex as a number. Sums of 10**18 lanes still fit their type."""
    return F.conv(F.substring(node, 16 * number + 1, 16), 16, 10).cast("decimal(20,0)")


def snapshot_summary(catalog: Catalog) -> DataFrame:
    """One row per complete snapshot that has entries, from a single pass over them.

    body_digest, row and kind counts, bytes, sha256 count and the first
    problem found.
    """
    complete = catalog.snapshots.where(F.col("status") == "complete").select(F.col("id").alias("snapshot_id"))
    is_file = F.col("kind") == "file"
    problem = entry_problem()
    hashed = catalog.entries.join(catalog.small_snapshots(complete), "snapshot_id").select(
        "snapshot_id",
        # No valid field holds a NUL, so it separates them; other entries fail the check below.
        F.sha2(F.concat_ws(NUL, *[F.col(c).cast("string") for c in _ENTRY_FIELDS]), 256).alias("node"),
        is_file.cast("long").alias("files"),
        (F.col("kind") == "directory").cast("long").alias("directories"),
        F.when(is_file, F.col("size")).otherwise(0).cast("decimal(19,0)").alias("bytes"),
        has_scheme(F.col("hash"), FULL).cast("long").alias("full_hashes"),
        F.when(problem.isNotNull(), F.concat_ws(": ", problem, "path")).alias("problem"),
    )
    sums = ("files", "directories", "bytes", "full_hashes")
    lanes = [f"lane{n}" for n in range(LANES)]
    added = hashed.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(_lane(F.col("node"), n)).alias(lane) for n, lane in enumerate(lanes)],
        F.min("problem").alias("problem"),
    )
    body = F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(c).cast("string") for c in lanes]), 256)
    return added.select("snapshot_id", body.alias("body_digest"), "rows", *sums, "problem")


def header_digest(body: Column) -> Column:
    return F.sha2(framed(*[F.col(c) for c in _HEADER_FIELDS], body), 256)


def snapshot_digests(snapshots: DataFrame, summary: DataFrame) -> DataFrame:
    """Digest of every complete snapshot: header fields, then the entries."""
    complete = snapshots.where(F.col("status") == "complete")
    joined = complete.join(summary.withColumnRenamed("snapshot_id", "id"), "id", "left")
    return joined.select(*complete.columns, *[c for c in summary.columns if c != "snapshot_id"],
                         header_digest(F.col("body_digest")).alias("digest"))
