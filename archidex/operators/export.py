"""Exports of the current view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.functions.paths import nocase
from archidex.operators.drives import drive_overview
from archidex.schema import EXPORT_VERSION, Catalog

# The columns of the exported file.
CSV_COLUMNS = ("drive_id", "drive_name", "location", "path", "kind", "size", "modified_at", "hash")
# Fixed value: how an unset time is written.
UNSET_TIME = "0001-01-01T00:00:00Z"


def export_rows(catalog: Catalog) -> DataFrame:
    """All current entries by drive name and path; times stay raw seconds."""
    rows = catalog.current_entries("path", "kind", "size", "modified_at", "hash").select(*CSV_COLUMNS)
    return rows.orderBy(nocase(F.col("drive_name")), nocase(F.col("path")), "drive_name", "path", "drive_id")


def write_csv(catalog: Catalog, path: str) -> None:
    """Ordered CSV parts with a header each; part order is row order."""
    export_rows(catalog).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def utc_text(seconds: Column, positive_only: bool = True) -> Column:
    """UTC time of unix seconds as text. Plain arithmetic on days, so the session's time zone has no part in it."""
    day = 24 * 60 * 60
    rest = F.pmod(seconds, F.lit(day))
    days = F.floor((seconds - rest) / day).try_cast("int")
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    clock = [two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60)]
    text = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit("T"), *clock, F.lit("Z"))
    return F.when(seconds > 0, text).otherwise(F.lit(UNSET_TIME)) if positive_only else text


def _drive_record() -> list[Column]:
    return [
        F.col("id").alias("drive_id"),
        F.struct(
            "id", "name", "source_path", "location", "notes", "tags", "fingerprint", "latest_snapshot_id",
            utc_text(F.col("created_at"), False).alias("created_at"),
            utc_text(F.col("updated_at"), False).alias("updated_at"),
            "file_count", "directory_count", "total_bytes",
            utc_text(F.col("last_scanned_at")).alias("last_scanned_at"),
        ).alias("body"),
    ]


def _snapshot_body() -> Column:
    return F.struct(
        "id", "drive_id", "source_path", "status", "hash_mode", "file_count", "directory_count", "total_bytes",
        "error_count", utc_text(F.col("started_at"), False).alias("started_at"),
        utc_text(F.coalesce(F.col("completed_at"), F.lit(0))).alias("completed_at"), F.nullif("failure", F.lit("")).alias("failure"),
    )


def _entry_body() -> Column:
    return F.struct(
        "id", "snapshot_id", "path", "parent_path", "name", "extension", "kind", "size",
        utc_text(F.col("modified_at")).alias("modified_at"), F.nullif("hash", F.lit("")).alias("hash"), "hidden",
    )


def _records(catalog: Catalog) -> DataFrame:
    """Drives, snapshots and current entries as JSON texts with their document order."""
    key = nocase(F.col("name")).alias("drive_key")
    drives = drive_overview(catalog).select(key, *_drive_record())
    keys = catalog.drives.select(F.col("id").alias("drive_id"), key)
    history = catalog.snapshots.join(catalog.small_drives(keys), "drive_id")
    # Newest first: text that sorts as the negated numbers do.
    newest_first = [
        F.lpad((F.lit(2**62) - c).cast("string"), 20, "0")
        for c in (F.coalesce(F.col("completed_at"), F.col("started_at")), F.col("id"))
    ]
    entries = catalog.current_entries().withColumn("drive_key", nocase(F.col("drive_name")))

    def records(df: DataFrame, section: int, record: str, place: Column, body: Column) -> DataFrame:
        return df.select(
            "drive_key", "drive_id", F.lit(section).alias("section"), place.alias("place"),
            F.lit(record).alias("record"), F.to_json(body).alias("body"),
        )

    return (
        records(drives, 0, "drive", F.lit(""), F.col("body"))
        .unionAll(records(history, 1, "snapshot", F.concat(*newest_first), _snapshot_body()))
        .unionAll(records(entries, 2, "entry", F.col("path"), _entry_body()))
    )


def export_json_lines(catalog: Catalog) -> DataFrame:
    """The whole export as one JSON text per line: drives, their snapshots, their entries.

    Columns ``drive_key``, ``section`` and ``place`` carry the document order.
    No row grows with a drive, so this form has no size limit.
    """
    opening = F.regexp_replace(F.to_json(F.struct("record", "drive_id")), r"\}$", "")
    line = F.concat(opening, F.lit(',"body":'), F.col("body"), F.lit("}"))
    return _records(catalog).select("drive_key", "drive_id", "section", "place", line.alias("line"))


def write_json_lines(catalog: Catalog, path: str) -> None:
    lines = export_json_lines(catalog).orderBy("drive_key", "drive_id", "section", "place")
    lines.select(F.col("line").alias("value")).write.text(path)


def export_document_lines(catalog: Catalog, exported_at: int) -> DataFrame:
    """The lines of one JSON document: version, export time, drives with nested lists.

    Written in (part, drive_key, drive_id, section, place) order the lines are
    the document, so nested lists of any length never sit in one row.
    """
    lines = _records(catalog)
    body = F.col("body")
    drive = lines.where(F.col("section") == 0)
    first_drive = drive.agg(F.min(F.struct("drive_key", "drive_id")).alias("first")).scalar()
    firsts = lines.where(F.col("section") > 0).groupBy("drive_id", "section").agg(F.min("place").alias("first"))
    # Two rows per drive: broadcast while the counted drives allow it, so one large drive is no hot key.
    items = lines.where(F.col("section") > 0).join(catalog.small_drives(firsts), ["drive_id", "section"])

    keys = ["drive_key", "drive_id"]
    head = F.lit('{"version":%d,"exported_at":"' % EXPORT_VERSION)
    frame = catalog.spark.range(1)
    blank = [F.lit("").alias(k) for k in keys]

    def rows(df: DataFrame, part: int, section: int, place, text, names=None) -> DataFrame:
        return df.select(
            F.lit(part).alias("part"), *(names or keys), F.lit(section).alias("section"), place.alias("place"), text.alias("line")
        )

    none = F.lit("")
    opened = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"snapshots":['))
    comma = F.when(F.struct(*keys) == first_drive, "").otherwise(",")
    doubled = items.withColumn("section", F.when(F.col("section") == 1, 1).otherwise(3))
    item = F.concat(F.when(F.col("place") == F.col("first"), "").otherwise(","), body)
    return (
        rows(frame, 0, 0, none, F.concat(head, utc_text(F.lit(exported_at).cast("long"), False), F.lit('","drives":[')), blank)
        .unionAll(rows(drive, 1, 0, none, F.concat(comma, opened)))
        .unionAll(doubled.select(F.lit(1).alias("part"), *keys, "section", "place", item.alias("line")))
        .unionAll(rows(drive, 1, 2, none, F.lit('],"latest_entries":[')))
        .unionAll(rows(drive, 1, 4, none, F.lit("]}")))
        .unionAll(rows(frame, 2, 0, none, F.lit("]}"), blank))
    )


def write_json_document(catalog: Catalog, path: str, exported_at: int) -> None:
    """Text parts whose concatenation in part order is one JSON document."""
    lines = export_document_lines(catalog, exported_at)
    ordered = lines.orderBy("part", "drive_key", "drive_id", "section", "place")
    ordered.select(F.col("line").alias("value")).write.text(path)
