"""Tag lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archidex.functions.paths import trim_space


def split_tags(value: Column) -> Column:
    """Comma-separated text to tags; blank text gives none."""
    blank = trim_space(F.coalesce(value, F.lit(""))) == ""
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(value, ","))


def normalize_tags(tags: Column) -> Column:
    """Trimmed, non-empty, first spelling kept among tags equal in lower case."""
    cleaned = F.filter(F.transform(tags, trim_space), lambda tag: tag != "")
    return F.aggregate(
        cleaned,
        F.array().cast("array<string>"),
        lambda kept, tag: F.when(
            F.exists(kept, lambda other: F.lower(other) == F.lower(tag)), kept
        ).otherwise(F.concat(kept, F.array(tag))),
    )


# Fixed value: a JSON array whose elements are strings or null, or a bare null.
_STRING_ELEMENT = r'("(?:[^"\\]|\\.)*"|null)'
JSON_TAGS_PATTERN = rf"^\s*(null|\[\s*({_STRING_ELEMENT}\s*(,\s*{_STRING_ELEMENT}\s*)*)?\])\s*$"


def parse_tags(text: Column) -> Column:
    """JSON array text to tags; text that is not an array of strings raises."""
    parsed = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    tags = F.transform(parsed, lambda tag: F.coalesce(tag, F.lit("")))
    problem = F.raise_error(F.concat(F.lit("malformed drive tags: "), text)).cast("array<string>")
    return F.when(text.rlike(JSON_TAGS_PATTERN), tags).otherwise(problem)
