from __future__ import annotations

import hashlib
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from archidex.functions import display, filelist, fingerprints, paths, tags
from archidex.functions.text import fold_tokens, occurrences, parse_query, token_text, tokens


def values(spark, inputs, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_paths(spark):
    given = [" \\a\\b\\ ", "/x/", "", "a/b/c.TXT", "\u00a0\ta\n"]
    assert values(spark, given, paths.catalog_path) == ["a/b", "x", "", "a/b/c.TXT", "a"]
    assert values(spark, ["a/b/c", "a", "", "a\nb/c"], paths.parent_of) == ["a/b", "", "", "a\nb"]
    assert values(spark, ["x.TXT", ".bashrc", "x.", "x", "a.tar.GZ"], paths.extension_of) == ["txt", "bashrc", "", "", "gz"]
    assert values(spark, ["ÉA", "Zé"], paths.nocase) == ["Éa", "zé"]
    assert values(spark, ["a/b/c", "a"], paths.ancestors) == [["a", "a/b", "a/b/c"], ["a"]]


def test_tags(spark):
    given = ["video, Video, \" 2026 \"", " ", "a,,b ,A", "Ä,ä"]
    found = values(spark, given, lambda c: tags.normalize_tags(tags.split_tags(c)))
    assert found == [["video", "\" 2026 \""], [], ["a", "b"], ["Ä"]]
    assert values(spark, ['["a","b"]', "[]", "null", " [ ] ", '["x\\"y", null]'], tags.parse_tags) == [
        ["a", "b"], [], [], [], ['x"y', ""],
    ]


@pytest.mark.parametrize("text", ['{"a":1}', '[1]', 'x', '["a"'])
def test_malformed_tags_raise(spark, text):
    with pytest.raises(Exception, match="malformed drive tags"):
        values(spark, [text], tags.parse_tags)


def test_file_list_sizes(spark):
    given = [" 12 ", "junk", "", None, "99999999999999999999", "-" + "9" * 60, "+7", "1.5", str(2**63 - 1)]
    assert values(spark, given, filelist.lenient_size) == [12, 0, 0, 0, 2**63 - 1, -(2**63), 7, 0, 2**63 - 1]


def test_file_list_times(spark):
    given = {
        "133801632000000000": (133801632000000000 - 116444736000000000) // 10**7,
        "1700000000": 1700000000,
        "0": 0,
        "-5": 0,
        "2024-01-02T03:04:05Z": 1704164645,
        "2024-01-02T03:04:05.25+01:00": 1704161045,
        "2024-01-02 03:04:05": 1704164645,
        "1/2/2024 3:04 PM": 1704207840,
        "13/02/2024 15:04": 1707836640,
        "31/02/2024 15:04": 0,
        "soon": 0,
        "99999999999999999999": 0,
    }
    assert values(spark, list(given), filelist.lenient_time) == list(given.values())
    shifted = values(spark, ["2024-01-02 03:04:05"], lambda c: filelist.lenient_time(c, "Europe/Berlin"))
    assert shifted == [1704161045]


def test_windows_paths(spark):
    given = ['"E:\\Archive\\\\Photos\\"', " a//b/ ", "\\\\server\\x"]
    assert values(spark, given, filelist.windows_path) == ["E:/Archive/Photos", "a/b", "/server/x"]
    strip = values(spark, ["E:/Archive/x", "E:/Archived", "F:/x"], lambda c: filelist.strip_leading(c, F.lit("E:/Archive")))
    assert strip == ["x", "d", "F:/x"]


@pytest.mark.parametrize("size", [0, 10, 65535, 65536, 65537, 70000, 131071, 131072, 131073, 200000])
def test_fingerprints(spark, size):
    data = bytes(i * 31 % 251 for i in range(size))
    row = spark.createDataFrame([(bytearray(data),)], "c binary").select(
        fingerprints.full_fingerprint(F.col("c")), fingerprints.quick_fingerprint(F.col("c"))
    ).head()
    tail = data[max(size - 65536, 65536):] if size > 65536 else b""
    quick = hashlib.sha256(size.to_bytes(8, "little") + data[:65536] + tail).hexdigest()
    assert (row[0], row[1]) == ("sha256:" + hashlib.sha256(data).hexdigest(), "quick:" + quick)


def test_display(spark):
    numbers = spark.createDataFrame([(0, 999), (1, 1000), (2, 1_500_000), (3, 1005), (4, 7 * 10**18)], "i int, v long")
    got = numbers.orderBy("i").select(
        display.human_bytes(F.col("v")), display.human_bytes(F.col("v"), 1), display.human_count(F.col("v"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("999 B", "999 B", "999"), ("1.00 KB", "1.0 KB", "1.0k"), ("1.50 MB", "1.5 MB", "1.5M"),
        ("1.00 KB", "1.0 KB", "1.0k"), ("7000.00 PB", "7000.0 PB", "7000000000000.0M"),
    ]
    assert values(spark, ["abcdef", "abc"], lambda c: display.shorten(c, 4)) == ["abc…", "abc"]


def _reference_tokens(texts):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.execute("create virtual table v using fts5vocab(t, instance)")
    con.executemany("insert into t(rowid, x) values(?, ?)", [(i + 1, t) for i, t in enumerate(texts)])
    found = [[] for _ in texts]
    for term, doc, _ in con.execute("select term, doc, offset from v order by doc, offset"):
        found[doc - 1].append(term)
    return found


def test_tokens_match_sqlite_for_every_letter(spark):
    # All of the BMP but 21 letters that were marks in the Unicode version of the tokenizer.
    were_marks = {*range(0x19B0, 0x19CA), 0x1CF2, 0x1CF3}
    chars = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}b" for c in chars]
    expected = _reference_tokens(texts)
    wrong = [
        c for c, t, e in zip(chars, texts, expected)
        if unicodedata.category(c)[0] in "LN" and ord(c) not in were_marks and fold_tokens(t) != e
    ]
    assert wrong == []
    # The column form relies on the JVM's Unicode version: compared where both know the character.
    known = unicodedata.ucd_3_2_0.category
    sample = [t for t, c in zip(texts, chars) if known(c)[0] in "LNPZS" or 0x300 <= ord(c) < 0x370]
    got = values(spark, sample, tokens)
    assert [g for g, s in zip(got, sample) if g != fold_tokens(s)] == []


def test_tokens_of_words(spark):
    texts = ["Aurora-final_v2.MOV", "Übergröße ÉTÉ", "", "---", "x/y/Z", "naïve\u0301 İstanbul", "東京 2024"]
    assert values(spark, texts, tokens) == _reference_tokens(texts) == [fold_tokens(t) for t in texts]


def test_occurrences_overlap(spark):
    text = token_text(F.lit("a a a ab b"))
    found = spark.range(1).select(
        occurrences(text, ["a"]), occurrences(text, ["a", "a"]), occurrences(text, ["ab"]), occurrences(text, ["a", "b"])
    ).head()
    assert tuple(found) == (4, 3, 1, 0)


def test_parse_query():
    assert parse_query(' "Aurora" final_cut ') == [["aurora"], ["final", "cut"]]
    assert parse_query("''  ") is None
    assert parse_query("aurora -") is None
    assert parse_query("it's") == [["it", "s"]]
