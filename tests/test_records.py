"""Lists whose fields hold line breaks, read in splits of every small size."""

from __future__ import annotations

import csv
import io
import random

import pytest

from archidex.sources import records
from archidex.sources.filelist import read_file_list
from archidex.sources.records import quoted_records
from tests.conftest import rows


@pytest.fixture
def small_splits(spark):
    """Splits of the given number of bytes, whatever the file's size."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    old = {k: spark.conf.get(k) for k in keys}

    def use(size, batch=10_000):
        for key, value in zip(keys, (size, 0, batch)):
            spark.conf.set(key, value)

    yield use
    for key, value in old.items():
        spark.conf.set(key, value)


def listed(seed: int, count: int, line_end: str = "\n") -> tuple[str, list[tuple[str, int]]]:
    """A list with fields over none to many lines, doubled quotes, commas and empty lines inside fields."""
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line_end)
    writer.writerow(["Remark", "Filename", "Size"])
    parts = ['"', "\n", ",", "x", "\n\n", '",', ',"', "é", " "]
    expected = []
    for number in range(count):
        remark = "".join(rng.choice(parts) for _ in range(rng.choice([0, 0, 1, 3, 40])))
        name = f"f{number}" + rng.choice(["", "\nsecond", ' "q"', ",c"]) + ".txt"
        writer.writerow([remark.replace("\n", line_end), name.replace("\n", line_end), number])
        expected.append((name, number))
    return out.getvalue(), sorted(expected)


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


@pytest.mark.parametrize("size, batch", [(9, 10_000), (64, 3), (10_000_000, 1)])
def test_records_over_split_borders(spark, tmp_path, small_splits, size, batch):
    first, second = (write(tmp_path / f"{n}.efu", listed(n, 8)[0]) for n in (1, 2))
    small_splits(size, batch)
    found = sorted((r["path"], r["size"]) for r in rows(read_file_list(spark, [first, second])))
    assert found == sorted(listed(1, 8)[1] + listed(2, 8)[1])


def test_one_list_is_read_by_many_tasks(spark, tmp_path, small_splits):
    text, expected = listed(3, 400)
    path = write(tmp_path / "many.efu", text)
    small_splits(1024)
    entries = read_file_list(spark, path)
    assert entries.rdd.getNumPartitions() > 5
    split = sorted(map(repr, rows(entries)))
    assert split == sorted(map(repr, rows(read_file_list(spark, path, multi_line=True))))
    assert len(split) == len(expected)


def test_splits_beyond_the_broadcast_bound_are_shuffled(spark, tmp_path, small_splits, monkeypatch):
    text, expected = listed(4, 60)
    path = write(tmp_path / "wide.efu", text)
    monkeypatch.setattr(records, "BROADCAST_ROWS", 0)
    small_splits(200, 7)
    assert sorted((r["path"], r["size"]) for r in rows(read_file_list(spark, path))) == expected


def test_line_ends_of_two_letters(spark, tmp_path, small_splits):
    path = write(tmp_path / "crlf.efu", listed(5, 40, "\r\n")[0])
    small_splits(100)
    assert sorted((r["path"], r["size"]) for r in rows(read_file_list(spark, path))) == listed(5, 40)[1]


def test_quotes_inside_plain_fields_open_nothing(spark, tmp_path, small_splits):
    path = write(tmp_path / "stray.efu", 'Filename,Size\n5" disk.txt,1\na"b,"2"\n"c\nd"x,3\n,"4\n5"\n"e"\n')
    small_splits(9)
    found = {(r["path"], r["size"]) for r in rows(read_file_list(spark, path))}
    assert {('5" disk.txt', 1), ('a"b', 2), ("e", 0)} <= found and len(found) == 4


def test_open_ends_headers_and_empty_lists(spark, tmp_path, small_splits):
    open_end = write(tmp_path / "open.efu", 'Filename,Size\na,1\n"b\nc\nd')
    wide_header = write(tmp_path / "header.efu", '"Re\nmark",Filename\nx,"y\nz"\n')
    bare = write(tmp_path / "bare.efu", '"Filename')
    for size in (5, 1000):
        small_splits(size)
        kept = {r["record"] for r in rows(quoted_records(spark, [open_end, wide_header, bare]))}
        assert kept == {"a,1", '"b\nc\nd', 'x,"y\nz"'}
