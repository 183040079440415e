"""Column expressions over catalog paths and names."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(value: Column) -> Column:
    return F.trim(value, F.lit(WHITESPACE))


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def nocase(value: Column) -> Column:
    """ASCII-only case folding: the key for names that differ in case alone.

    Plain ASCII text, the usual case, takes the faster ``lower``.
    """
    folded = F.translate(value, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(is_ascii(value), F.lower(value)).otherwise(folded)


def forward_slashes(value: Column) -> Column:
    return F.replace(value, F.lit("\\"), F.lit("/"))


def catalog_path(value: Column) -> Column:
    return F.trim(forward_slashes(trim_space(value)), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    name_length = F.length(base_name(path))
    return F.left(path, F.greatest(F.length(path) - name_length - 1, F.lit(0)))


def extension_of(name: Column) -> Column:
    """Lower-case text after the last dot, empty without one."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def ancestors(path: Column) -> Column:
    """All leading paths of ``path``, itself last: a/b/c gives [a, a/b, a/b/c]."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
