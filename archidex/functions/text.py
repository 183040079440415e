"""Search text: folding, tokens and phrase counting.

A text is indexed as one string of folded tokens, each with a space before
it (" aurora final mov").  A prefix phrase is then a plain substring that
starts at a space, so counting needs no arrays and stays in generated code.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from archidex.functions.paths import is_ascii

# Fixed values of the tokenizer being matched. Ranges are inclusive.
# Combining marks that vanish inside a token.
DELETED_MARKS = (
    (0x0300, 0x0304), (0x0306, 0x030C), (0x030F, 0x030F), (0x0311, 0x0311), (0x031B, 0x031B),
    (0x0323, 0x0328), (0x032D, 0x032E), (0x0330, 0x0331),
)
# Cased letters younger than the tokenizer's case table: kept as they are.
UNFOLDED = (
    (0x037F, 0x037F), (0x0528, 0x0528), (0x052A, 0x052A), (0x052C, 0x052C), (0x052E, 0x052E),
    (0x13F8, 0x13FD), (0x1C80, 0x1C88), (0x1C90, 0x1CBA), (0x1CBD, 0x1CBF), (0x2C2F, 0x2C2F),
    (0xA698, 0xA698), (0xA69A, 0xA69A), (0xA796, 0xA796), (0xA798, 0xA798), (0xA79A, 0xA79A),
    (0xA79C, 0xA79C), (0xA79E, 0xA79E), (0xA7AB, 0xA7AE), (0xA7B0, 0xA7B4), (0xA7B6, 0xA7B6),
    (0xA7B8, 0xA7B8), (0xA7BA, 0xA7BA), (0xA7BC, 0xA7BC), (0xA7BE, 0xA7BE), (0xA7C0, 0xA7C0),
    (0xA7C2, 0xA7C2), (0xA7C4, 0xA7C7), (0xA7C9, 0xA7C9), (0xA7D0, 0xA7D0), (0xA7D6, 0xA7D6),
    (0xA7D8, 0xA7D8), (0xA7F5, 0xA7F5), (0xAB70, 0xABBF),
)
# Letters whose folding the rule in _fold_char would get wrong.
IRREGULAR = {"İ": "i", "Ǡ": "ǡ", "ǡ": "ǡ"}

SEPARATOR_PATTERN = r"[^\p{L}\p{N}\p{Co}]+"
ASCII_SEPARATOR_PATTERN = "[^a-z0-9]+"


def _inside(code: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(low <= code <= high for low, high in ranges)


def _is_token_char(char: str) -> bool:
    category = unicodedata.category(char)
    return category[0] in "LN" or category == "Co"


def _fold_char(char: str) -> str:
    """One character to one: case folding, and accents dropped from Latin letters."""
    if char in IRREGULAR:
        return IRREGULAR[char]
    if not _is_token_char(char) or _inside(ord(char), UNFOLDED):
        return char
    folded = next((f for f in (char.casefold(), char.lower()) if len(f) == 1), char)
    base = unicodedata.normalize("NFD", folded)[0]
    return base if "a" <= base <= "z" else folded


@functools.cache
def fold_table() -> tuple[str, str]:
    """``translate`` arguments: mapped characters first, deleted marks after them."""
    source, target = [], []
    for code in range(0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = _fold_char(chr(code))
        if folded != chr(code):
            source.append(chr(code))
            target.append(folded)
    marks = [chr(c) for low, high in DELETED_MARKS for c in range(low, high + 1)]
    return "".join(source + marks), "".join(target)


def token_text(value: Column) -> Column:
    """Folded tokens of ``value``, each with a space before it; empty without tokens.

    ASCII text takes a short cut around the folding table, to the same result.
    """
    folded = F.regexp_replace(F.translate(value, *fold_table()), SEPARATOR_PATTERN, " ")
    plain = F.regexp_replace(F.lower(value), ASCII_SEPARATOR_PATTERN, " ")
    words = F.when(is_ascii(value), plain).otherwise(folded)
    return F.rtrim(F.concat(F.lit(" "), F.ltrim(words)))


def token_count(text: Column) -> Column:
    """Tokens in a ``token_text`` string."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def tokens(value: Column) -> Column:
    """Tokens of ``value`` as an array."""
    return F.filter(F.split(token_text(value), " "), lambda token: token != "")


def occurrences(text: Column, phrase: list[str]) -> Column:
    """How often the token phrase occurs in a ``token_text``; its last token is a prefix."""
    needle = " " + " ".join(phrase)
    if _overlaps_itself(phrase):
        return F.regexp_count(text, F.lit(f"(?={re.escape(needle)})"))
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("int")


def _overlaps_itself(phrase: list[str]) -> bool:
    """Whether a second match may start inside the first one."""
    return any(
        all(a == b for a, b in zip(phrase[shift:-1], phrase)) and phrase[len(phrase) - shift - 1].startswith(phrase[-1])
        for shift in range(1, len(phrase))
    )


@functools.cache
def _fold_map() -> dict[int, str | None]:
    source, target = fold_table()
    return {ord(c): (target[i] if i < len(target) else None) for i, c in enumerate(source)}


def fold_tokens(value: str) -> list[str]:
    """Driver-side twin of ``tokens`` for the words of a query."""
    return "".join(c if _is_token_char(c) else " " for c in value.translate(_fold_map())).split()


def parse_query(query: str) -> list[list[str]] | None:
    """Prefix phrases of a query, one per whitespace-separated part.

    None if there is no usable part, or if a part holds no token at all: such
    a part matches nothing and all parts have to match.
    """
    parts = [part.strip("\"'") for part in query.split()]
    phrases = [fold_tokens(part) for part in parts if part]
    return phrases if phrases and all(phrases) else None
