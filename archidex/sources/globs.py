"""Exclusion globs compiled to one anchored regular expression."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.functions.paths import WHITESPACE

# A slash or the end of the text, spelled so that Java and Python agree.
_END = r"(?:/|(?![\s\S]))"
_TREE = "/**"


class _Malformed(ValueError):
    pass


def _quote(char: str) -> str:
    return char if char.isalnum() or char in "_ /" or ord(char) > 127 else "\\" + char


def _class_item(pattern: str, at: int) -> tuple[str, int]:
    if at >= len(pattern) or pattern[at] in "-]":
        raise _Malformed
    if pattern[at] == "\\":
        at += 1
        if at >= len(pattern):
            raise _Malformed
    return pattern[at], at + 1


def _character_class(pattern: str, at: int) -> tuple[str, int]:
    """The class that opens at ``pattern[at]`` and the position behind it."""
    at += 1
    negated = pattern[at : at + 1] == "^"
    at += negated
    body, items = [], 0
    while pattern[at : at + 1] != "]" or not items:
        low, at = _class_item(pattern, at)
        high = low
        if pattern[at : at + 1] == "-":
            high, at = _class_item(pattern, at + 1)
        items += 1
        if low <= high:
            body.append(f"{_quote(low)}-{_quote(high)}")
    if not body:
        return (r"[\s\S]" if negated else r"(?!)"), at + 1
    return f"[{'^' if negated else ''}{''.join(body)}]", at + 1


def glob_regex(pattern: str, within_segment: bool) -> str | None:
    """Unanchored regex of a glob, valid in Java and Python; None if the glob is malformed."""
    out, at = [], 0
    try:
        while at < len(pattern):
            char = pattern[at]
            if char == "*":
                out.append("[^/]*")
            elif char == "?":
                out.append("[^/]")
            elif char == "[":
                text, at = _character_class(pattern, at)
                out.append(f"(?!/){text}" if within_segment else text)
                continue
            elif char == "\\":
                at += 1
                if at >= len(pattern):
                    raise _Malformed
                out.append(_quote(pattern[at]))
            else:
                out.append(_quote(char))
            at += 1
    except _Malformed:
        return None
    return "".join(out)


def exclusion_regex(patterns: Iterable[str]) -> str | None:
    """One regex that finds a match in every path to drop.

    A match has to end at a segment boundary, so it covers an entry or one of
    its parent folders: an excluded folder takes its whole subtree with it.
    """
    alternatives = []
    for pattern in (p.strip(WHITESPACE) for p in patterns):
        if not pattern:
            continue
        if pattern.endswith(_TREE):
            alternatives.append("^" + "".join(map(_quote, pattern[: -len(_TREE)])) + _END)
        by_path = glob_regex(pattern, within_segment=False)
        if by_path is not None:
            alternatives.append(f"^{by_path}{_END}")
        by_name = glob_regex(pattern, within_segment=True)
        if by_name is not None and "/" not in re.sub(r"\[\^/\]\*?|\(\?!/\)", "", by_name):
            alternatives.append(f"(?:^|/){by_name}{_END}")
    return "|".join(f"(?:{a})" for a in alternatives) or None


def is_excluded(path: Column, patterns: Iterable[str]) -> Column:
    regex = exclusion_regex(patterns)
    return F.lit(False) if regex is None else path.rlike(regex)


def exclude_globs(entries: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Entries whose path, name or any parent folder matches no pattern."""
    regex = exclusion_regex(patterns)
    return entries if regex is None else entries.where(~F.col("path").rlike(regex))
