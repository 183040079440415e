"""Digests of folders and comparison by descent, beside a recursive digest and the plain comparison."""

from __future__ import annotations

import hashlib
import random

import pytest

from archidex.operators.diff import diff_all
from archidex.operators.folders import changed_folders, descent_report, diff_by_descent, folder_digests
from tests.conftest import catalog_of, entry, rows

DRIVE = {"id": "drv_000000000001", "name": "One", "latest_snapshot_id": 2}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(*values) -> str:
    return "".join(f"{len(str(v).encode())}:{v}" for v in values)


def joined(children: list[tuple[str, str]], fan: int, steps: int) -> str:
    """Digest of (place, node) pairs; a large folder's go by their leading digits first."""
    for step in range(steps, 0, -1):
        groups: dict[str, list] = {}
        for place, node in children:
            groups.setdefault(place[: 3 * step], []).append((place, node))
        children = [(place, sha("".join(n for _, n in sorted(group)))) for place, group in groups.items()]
    return sha("".join(node for _, node in sorted(children)))


def expected(entries: list[dict], fan: int) -> dict[str, tuple[str, str, int]]:
    folders = {""}
    for e in entries:
        parts = (e["path"] if e["kind"] == "directory" else e["parent_path"]).split("/")
        folders |= {"/".join(parts[:n]) for n in range(len(parts) + 1)}

    def of(children):
        steps = sum(len(children) > fan * 4096**n for n in range(3))
        return joined([(sha(name), node) for name, node in children], fan, steps)

    def digest(path):
        own = [
            (e["name"], sha(framed(e["name"], e["extension"], e["kind"], e["size"], e["modified_at"], e["hash"], str(e["hidden"]).lower())))
            for e in entries if e["parent_path"] == path
        ]
        level = of(own) if own else sha("")
        inner = [f for f in folders if f and f.rpartition("/")[0] == path]
        below = of([(f.rpartition("/")[2], sha(framed(f.rpartition("/")[2], digest(f)[1]))) for f in inner]) if inner else ""
        return level, sha(level + below), len(own)

    return {path: digest(path) for path in folders} if entries else {}


def tree(snapshot: int, seed: int, changes: int = 0) -> list[dict]:
    rng = random.Random(seed)
    found = {}
    for number in range(60):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randrange(4)))
        path = f"{folder}/f{number}".lstrip("/")
        found[path] = entry(snapshot, path, size=rng.randrange(9), modified_at=5, hash_=rng.choice(["", "sha256:" + "a" * 64]))
    for path in ("a", "b/empty", "c/c"):
        found[path] = entry(snapshot, path, kind="directory")
    rng = random.Random(seed + 1)
    for path in rng.sample(sorted(found), changes):
        if rng.random() < 0.4:
            del found[path]
        else:
            found[path] = {**found[path], "size": 77}
    return list(found.values())


def two_scans(spark, old, new):
    scans = [{"id": i, "drive_id": DRIVE["id"]} for i in (1, 2)]
    return catalog_of(spark, [DRIVE], scans, old + new)


@pytest.mark.parametrize("fan", [4096, 5])
def test_digests_equal_a_recursive_digest(spark, fan):
    old, new = tree(1, 7), tree(2, 7, changes=6)
    found = rows(folder_digests(two_scans(spark, old, new).entries, fan))
    for snapshot, entries in ((1, old), (2, new)):
        own = {r["path"]: (r["level"], r["digest"], r["entries"]) for r in found if r["snapshot_id"] == snapshot}
        assert own == expected(entries, fan)
    assert all(r["depth"] == (r["path"].count("/") + 1 if r["path"] else 0) for r in found)


@pytest.mark.parametrize("changes", [0, 1, 12])
def test_descent_equals_the_join(spark, changes):
    catalog = two_scans(spark, tree(1, 8), tree(2, 8, changes))
    folders = folder_digests(catalog.entries)
    found = rows(diff_by_descent(catalog, 1, 2, folders))
    assert sorted(map(repr, found)) == sorted(map(repr, rows(diff_all(catalog, 1, 2))))
    report = rows(descent_report(folders, 1, 2))[0]
    assert report["entries"] == len(rows(catalog.entries))
    if changes == 0:
        assert not found and report["folders_seen"] == 2 and report["entries_read"] == 0
    if changes == 1:
        assert len(found) == 1 and report["folders_read"] == 2 and report["folders_seen"] < report["folders"] / 2


def test_a_moved_folder_keeps_its_digest_and_new_folders_are_entered(spark):
    old = [entry(1, "x/in/f", 3), entry(1, "keep", 1)]
    new = [entry(2, "y/z/in/f", 3), entry(2, "keep", 1)]
    catalog = two_scans(spark, old, new)
    folders = folder_digests(catalog.entries)
    by_path = {(r["snapshot_id"], r["path"]): r["digest"] for r in rows(folders)}
    assert by_path[1, "x/in"] == by_path[2, "y/z/in"] and by_path[1, "x"] != by_path[2, "y"]
    assert {r["path"] for r in rows(changed_folders(folders, 1, 2)) if r["differs"]} == {"", "x", "x/in", "y", "y/z", "y/z/in"}
    assert {(r["path"], r["change"]) for r in rows(diff_by_descent(catalog, 1, 2))} == {("x/in/f", "removed"), ("y/z/in/f", "added")}


def test_snapshots_without_entries(spark):
    catalog = two_scans(spark, [], [entry(2, "a/f", 1)])
    assert {r["change"] for r in rows(diff_by_descent(catalog, 1, 2))} == {"added"}
    none = two_scans(spark, [], [])
    assert rows(folder_digests(none.entries)) == [] and rows(diff_by_descent(none, 1, 2)) == []
