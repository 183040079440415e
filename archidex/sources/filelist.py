"""File lists exported as CSV (Filename, Size, Date Modified, Attributes)."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archidex.functions import filelist as fields
from archidex.functions.paths import base_name, extension_of, is_hidden, parent_of
from archidex.schema import CatalogError
from archidex.sources.records import quoted_records


def _forms(spark: SparkSession, paths: list[str]) -> dict[tuple[str, bool], list[str]]:
    """The lists by header line, and by whether a line has an odd number of quotes, i.e. a field may cross lines.

    One pass over the text; a row per list comes back, as in the listing of the files itself.
    """
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    lines = spark.read.text(paths).select(
        value, (quotes % 2 == 1).alias("odd"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
    )
    facts = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"), F.bool_or("odd").alias("spans"))
    forms: dict[tuple[str, bool], list[str]] = {}
    for row in facts.orderBy("file").toLocalIterator():
        forms.setdefault((row["header"], row["spans"]), []).append(row["file"])
    return forms


def _column(header: list[str], wanted: str) -> Column | None:
    """The last header that equals ``wanted``, ignoring case, space and a byte-order mark."""
    found = [name for name in header if name.lstrip("﻿").strip().lower() == wanted]
    return F.col(f"`{found[-1]}`") if found else None


def parse_rows(raw: DataFrame, strip_prefix: str = "", zone: str | None = None) -> DataFrame:
    """Entries from file-list rows whose columns carry the header names."""
    filename = _column(raw.columns, "filename")
    if filename is None:
        raise CatalogError("invalid file list: missing Filename column")
    blank = F.lit("")
    attributes = _column(raw.columns, "attributes")
    attributes = blank if attributes is None else F.coalesce(attributes, blank)
    size = _column(raw.columns, "size")
    modified = _column(raw.columns, "date modified")

    prefix = fields.windows_path(F.lit(strip_prefix))
    path = fields.strip_leading(fields.windows_path(F.coalesce(filename, blank)), prefix)
    directory = F.contains(F.upper(attributes), F.lit("D"))
    zero = F.lit(0).cast("long")
    origin = [F.col("origin")] if "origin" in raw.columns else []
    return (
        raw.select(
            *origin,
            path.alias("path"),
            directory.alias("directory"),
            (zero if size is None else fields.lenient_size(size)).alias("listed_size"),
            (zero if modified is None else fields.lenient_time(modified, zone)).alias("listed_time"),
        )
        .where(F.col("path") != "")
        .select(
            *origin,
            "path",
            parent_of(F.col("path")).alias("parent_path"),
            base_name(F.col("path")).alias("name"),
            F.when(F.col("directory"), blank).otherwise(extension_of(base_name(F.col("path")))).alias("extension"),
            F.when(F.col("directory"), "directory").otherwise("file").alias("kind"),
            F.when(F.col("directory"), zero).otherwise(F.col("listed_size")).alias("size"),
            F.when(F.col("directory"), zero).otherwise(F.col("listed_time")).alias("modified_at"),
            blank.alias("hash"),
            is_hidden(base_name(F.col("path"))).alias("hidden"),
        )
    )


def read_file_list(
    spark: SparkSession,
    paths: str | list[str],
    strip_prefix: str = "",
    zone: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Entries of one or more file lists, with the list as ``origin``.

    Each list is read by its own header line, and in splits; those in which a
    quoted field may cross a line end are cut into records first. With
    ``multi_line`` every list is read whole by one task, or, if it is False,
    every line is a record. A list without a line is an error.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    forms = _forms(spark, paths)
    if not forms:
        raise CatalogError("file list without a header")
    parts = []
    for (header, spans), files in forms.items():
        names = _names(header)
        if spans and multi_line is None:
            raw = _split_rows(quoted_records(spark, files), names)
        else:
            reader = spark.read.options(quote='"', escape='"', multiLine=bool(multi_line))
            schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
            raw = reader.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
            raw = raw.withColumn("origin", F.col("_metadata.file_path"))
        parts.append(parse_rows(raw, strip_prefix, zone))
    return reduce(DataFrame.unionByName, parts)


def _split_rows(records: DataFrame, names: list[str]) -> DataFrame:
    """The columns of a list's records, as the reader of whole lists names them."""
    schema = ", ".join(f"`{name}` string" for name in names)
    row = F.from_csv("record", schema, {"quote": '"', "escape": '"'}).alias("row")
    fields_of = [F.col(f"row.`{name}`") for name in names if name.lower() != "origin"]
    return records.where(F.col("record") != "").select(F.col("file").alias("origin"), row).select("origin", *fields_of)


def _names(header: str) -> list[str]:
    """Names of a header line, made unique so that a repeated one can be addressed."""
    names: list[str] = []
    for index, name in enumerate(next(csv.reader([header]), [])):
        name = (name or "").replace("`", "").lstrip("﻿")
        while name in names or not name:
            name = f"{name} " if name else f"_c{index}"
        names.append(name)
    return names


def repeated_paths(entries: DataFrame) -> DataFrame:
    """Paths listed more than once; any of them makes the list unusable as one snapshot."""
    keys = [c for c in ("origin", "snapshot_id") if c in entries.columns]
    return entries.groupBy(*keys, "path").count().where(F.col("count") > 1)
