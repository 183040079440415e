"""Staged proof of duplicates against hashing everything."""

from __future__ import annotations

import os
import random

import pytest

from archidex.functions.fingerprints import QUICK_SAMPLE
from archidex.sources import staged
from archidex.sources.inventory import file_inventory
from tests.conftest import rows


def write(root, path, content):
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "wb") as file:
        file.write(content)


@pytest.fixture()
def tree(tmp_path):
    root, draw = str(tmp_path), random.Random(5)
    big = draw.randbytes(5 * QUICK_SAMPLE)
    middle = bytearray(big)
    middle[2 * QUICK_SAMPLE + 7] ^= 1
    edge = bytearray(big)
    edge[3] ^= 1
    write(root, "a/one", big)
    write(root, "b/copy", big)
    write(root, "a/middle", bytes(middle))  # samples say equal, content is not
    write(root, "a/edge", bytes(edge))  # samples differ
    write(root, "a/alone", big[:-1])  # size of its own
    for size in (2 * QUICK_SAMPLE, 2 * QUICK_SAMPLE + 1, QUICK_SAMPLE, QUICK_SAMPLE + 1, 5):
        write(root, f"c/x{size}", big[:size])
        write(root, f"d/y{size}", big[:size])
        write(root, f"e/z{size}", bytes(reversed(big[:size])))
    write(root, "f/empty", b"")
    write(root, "g/empty", b"")
    for i in range(40):
        write(root, f"h/{i}", bytes(draw.choices(b"ab", k=3)))
    return root


def groups_by_full_hash(spark, root):
    groups = {}
    for row in rows(file_inventory(spark, root, hash_mode="full")):
        if row["kind"] == "file":
            groups.setdefault((row["hash"], row["size"]), set()).add(row["path"])
    return {k: v for k, v in groups.items() if len(v) > 1}


def test_same_groups_as_hashing_everything(spark, tree):
    files = staged.staged_fingerprints(spark, tree)
    found = {}
    for row in rows(staged.staged_duplicates(files)):
        found.setdefault((row["hash"], row["size"]), set()).add(row["path"])
        assert row["copies"] > 1
    assert found == groups_by_full_hash(spark, tree)
    assert sum(1 for r in rows(files)) == sum(len(f) for _, _, f in os.walk(tree))


def test_stages_and_bytes(spark, tree):
    files = {r["path"]: r for r in rows(staged.staged_fingerprints(spark, tree))}
    big = 5 * QUICK_SAMPLE
    assert {p: (files[p]["stage"], files[p]["bytes_read"]) for p in ("a/one", "b/copy", "a/middle", "a/edge", "a/alone")} == {
        "a/one": ("full", 2 * QUICK_SAMPLE + big), "b/copy": ("full", 2 * QUICK_SAMPLE + big),
        "a/middle": ("full", 2 * QUICK_SAMPLE + big), "a/edge": ("quick", 2 * QUICK_SAMPLE), "a/alone": ("size", 0),
    }
    assert files["a/one"]["quick_hash"] == files["a/middle"]["quick_hash"] and files["a/one"]["hash"] != files["a/middle"]["hash"]
    assert files["a/edge"]["hash"] is None and files["a/alone"]["quick_hash"] is None
    # What two samples cover is read once.
    assert files[f"c/x{2 * QUICK_SAMPLE}"]["stage"] == "quick" and files[f"c/x{2 * QUICK_SAMPLE}"]["hash"] is not None
    assert files[f"c/x{2 * QUICK_SAMPLE + 1}"]["stage"] == "full"
    report = {r["stage"]: r for r in rows(staged.reading_report(staged.staged_fingerprints(spark, tree)))}
    assert report["size"]["bytes_read"] == 0 and report["full"]["files"] == 5
    assert sum(r["files"] for r in report.values()) == len(files)


def test_quick_hash_is_that_of_the_inventory(spark, tree):
    quick = {r["path"]: r["hash"] for r in rows(file_inventory(spark, tree, hash_mode="quick"))}
    opened = [r for r in rows(staged.staged_fingerprints(spark, tree)) if r["quick_hash"]]
    assert opened and all(quick[r["path"]] == r["quick_hash"] for r in opened)


def test_a_file_that_changed_is_an_error(spark, tree):
    path = os.path.join(tree, "a/one")
    for read in (staged.read_samples, staged.read_whole):
        with pytest.raises(OSError, match=staged.CHANGED):
            read(path, 5 * QUICK_SAMPLE - 1)


def test_excluded_and_empty_trees(spark, tree, tmp_path_factory):
    assert {r["path"].split("/")[0] for r in rows(staged.staged_fingerprints(spark, tree, ["a", "h"]))} == set("bcdefg")
    assert rows(staged.staged_fingerprints(spark, str(tmp_path_factory.mktemp("none")))) == []
