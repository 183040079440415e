"""Checks that a source catalog has to pass before it is merged.

Each check returns the violations as rows (subject, problem); an empty frame
means the check passed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.functions.fingerprints import FINGERPRINT_PATTERN
from archidex.functions.paths import base_name, parent_of, trim_space
from archidex.operators.lifecycle import entry_counters
from archidex.schema import HASH_MODES, KINDS, Catalog

# The form of drive ids; segments that are empty, here or above.
DRIVE_ID_PATTERN = "^drv_[0-9a-f]{12}$"
UNSAFE_SEGMENTS = ("//", "/./", "/../")
NUL = "\0"
LONG_MAX = 2**63 - 1


def _has_nul(value: Column) -> Column:
    return F.contains(value, F.lit(NUL))


def _has_any(value: Column, *parts: str) -> Column:
    """Whether one of the texts occurs; plain searches, as this runs on every entry."""
    return reduce(lambda a, b: a | b, (F.contains(value, F.lit(part)) for part in parts))


def _first_problem(*checks: tuple[Column, str]) -> Column:
    problem = F.when(checks[0][0], checks[0][1])
    for condition, text in checks[1:]:
        problem = problem.when(condition, text)
    return problem


def drive_problem() -> Column:
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("source_path", "location", "notes", "fingerprint")]
    name = F.coalesce(F.col("name"), F.lit(""))
    return _first_problem(
        (~F.coalesce(F.col("id"), F.lit("")).rlike(DRIVE_ID_PATTERN), "invalid drive id"),
        ((trim_space(name) == "") | _has_nul(name), "invalid name"),
        (_has_nul(F.concat(*texts)), "NUL metadata"),
        (F.exists(F.coalesce(F.col("tags"), F.array().cast("array<string>")), _has_nul), "NUL tag"),
    )


def snapshot_problem() -> Column:
    counters = ("file_count", "directory_count", "total_bytes", "error_count")
    negative = F.least(*[F.col(c) for c in counters]) < 0
    completed = F.coalesce(F.col("completed_at"), F.lit(0))
    return _first_problem(
        (negative, "negative counts"),
        ((completed <= 0) | (completed < F.col("started_at")), "invalid timestamps"),
        (~F.col("hash_mode").isin(*HASH_MODES), "invalid hash mode"),
        (_has_nul(F.concat("source_path", F.coalesce("failure", F.lit("")))), "NUL metadata"),
    )


def entry_problem() -> Column:
    path, name, extension, value = F.col("path"), F.col("name"), F.col("extension"), F.col("hash")
    slash = F.lit("/")
    required = ("path", "parent_path", "name", "extension", "kind", "size", "modified_at", "hash")
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required))
    bad_path = (path == "") | _has_any(path, "\\", NUL) | F.startswith(path, slash) | F.endswith(path, slash)
    return _first_problem(
        (missing, "missing value"),
        (bad_path, "invalid path"),
        (_has_any(F.concat(slash, path, slash), *UNSAFE_SEGMENTS), "unsafe path"),
        ((name == "") | _has_any(name, "/", "\\", NUL) | (base_name(path) != name), "inconsistent name"),
        (F.col("parent_path") != parent_of(path), "inconsistent parent"),
        (_has_any(extension, "/", "\\", NUL) | _has_nul(value) | (F.octet_length(value) > 256), "invalid metadata"),
        ((value != "") & ~value.rlike(FINGERPRINT_PATTERN), "invalid fingerprint"),
        (F.col("size") < 0, "negative size"),
        (~F.col("kind").isin(*KINDS), "invalid kind"),
        (F.col("hidden").isNull(), "invalid hidden flag"),
    )


def validate_drives(drives: DataFrame) -> DataFrame:
    return drives.select("id", drive_problem().alias("problem")).where(F.col("problem").isNotNull())


def validate_snapshots(snapshots: DataFrame) -> DataFrame:
    """Problems of complete snapshots; others are never merged."""
    complete = snapshots.where(F.col("status") == "complete")
    return complete.select("id", snapshot_problem().alias("problem")).where(F.col("problem").isNotNull())


def validate_entries(entries: DataFrame) -> DataFrame:
    """Problems of entries; one filter inside generated code, no shuffle."""
    checked = entries.select("snapshot_id", "path", entry_problem().alias("problem"))
    return checked.where(F.col("problem").isNotNull())


def check_relationships(catalog: Catalog) -> DataFrame:
    """References to rows that do not exist: (child, reference, problem).

    Entries are first reduced to their distinct snapshot ids, so the joins
    see one row per snapshot, not per entry.
    """
    snapshot_ids = catalog.snapshots.select(F.col("id").alias("key"))
    drive_ids = catalog.drives.select(F.col("id").alias("key"))

    def missing(df: DataFrame, child: str, column: str, parents: DataFrame, problem: str) -> DataFrame:
        wanted = df.select(F.col(column).alias("key")).where(F.col("key").isNotNull()).distinct()
        return wanted.join(parents, "key", "left_anti").select(
            F.lit(child).alias("child"), F.col("key").cast("string").alias("reference"), F.lit(problem).alias("problem")
        )

    return (
        missing(catalog.entries, "entries", "snapshot_id", snapshot_ids, "no such snapshot")
        .unionAll(missing(catalog.snapshots, "snapshots", "drive_id", drive_ids, "no such drive"))
        .unionAll(missing(catalog.drives, "drives", "latest_snapshot_id", snapshot_ids, "no such snapshot"))
        .unionAll(missing(catalog.imports, "imports", "target_snapshot_id", snapshot_ids, "no such snapshot"))
    )


def wide_counters(entries: DataFrame) -> DataFrame:
    """Recounted files, directories and bytes per snapshot, bytes beyond the long range included."""
    wide = entries.select("snapshot_id", "kind", F.col("size").cast("decimal(19,0)").alias("size"))
    return entry_counters(wide)


def count_mismatches(snapshots: DataFrame, counted: DataFrame) -> DataFrame:
    """Declared against recounted numbers of complete snapshots, where they differ."""
    recounted = counted.select(
        F.col("snapshot_id").alias("id"), F.col("file_count").alias("files"),
        F.col("directory_count").alias("directories"), F.col("total_bytes").cast("decimal(38,0)").alias("bytes"),
    )
    zero = F.lit(0)
    joined = snapshots.where(F.col("status") == "complete").join(recounted, "id", "left").withColumns({
        "files": F.coalesce("files", zero), "directories": F.coalesce("directories", zero),
        "bytes": F.coalesce(F.col("bytes"), zero.cast("decimal(38,0)")),
    })
    overflow = F.col("bytes") > F.lit(LONG_MAX).cast("decimal(38,0)")
    differs = (
        (F.col("files") != F.col("file_count"))
        | (F.col("directories") != F.col("directory_count"))
        | (F.col("bytes") != F.col("total_bytes"))
    )
    problem = F.when(overflow, "too many bytes for a counter").when(differs, "counters differ from the entries")
    return joined.select(
        "id", "file_count", "files", "directory_count", "directories", "total_bytes", "bytes", problem.alias("problem")
    ).where(F.col("problem").isNotNull())


def reconcile_counts(catalog: Catalog) -> DataFrame:
    return count_mismatches(catalog.snapshots, wide_counters(catalog.entries))
