from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from archidex.schema import CatalogError
from archidex.sources.filelist import read_file_list, repeated_paths
from archidex.sources.globs import exclude_globs, exclusion_regex
from archidex.sources.inventory import binary_fingerprints, file_inventory, inventory_entries, inventory_summary
from archidex.streaming.progress import observed
from tests.conftest import rows

LIST = (
    "\ufeffFilename,Size,Date Modified,Attributes\n"
    '"D:\\Vault\\maps\\",17,132223104000000000,HD\n'
    '"D:\\Vault\\maps\\north; old.TIFF",81920,132223104000000000,HA\n'
)


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


@pytest.mark.parametrize("multi_line", [None, True])
def test_file_list(spark, tmp_path, multi_line):
    path = write(tmp_path / "a.efu", LIST)
    found = {r["path"]: r for r in rows(read_file_list(spark, path, "D:\\Vault", multi_line=multi_line).drop("origin"))}
    assert set(found) == {"maps", "maps/north; old.TIFF"}
    assert (found["maps"]["kind"], found["maps"]["size"], found["maps"]["modified_at"]) == ("directory", 0, 0)
    scan = found["maps/north; old.TIFF"]
    assert (scan["extension"], scan["size"], scan["parent_path"]) == ("tiff", 81920, "maps")
    assert scan["modified_at"] == 1577836800 and scan["hash"] == "" and scan["hidden"] is False


def test_file_lists_with_unlike_headers(spark, tmp_path):
    first = write(tmp_path / "one.efu", "Filename,Size\na.txt,3\n")
    second = write(tmp_path / "two.efu", 'Size,Remark,Filename\n7,"x\ny",b.txt\n8,,c.txt\n')
    third = write(tmp_path / "three.efu", "filename\nd.txt\n")
    found = rows(read_file_list(spark, [first, second, third]))
    assert {(r["path"], r["size"], r["origin"].rsplit("/", 1)[1]) for r in found} == {
        ("a.txt", 3, "one.efu"), ("b.txt", 7, "two.efu"), ("c.txt", 8, "two.efu"), ("d.txt", 0, "three.efu"),
    }


def test_file_list_headers_and_short_rows(spark, tmp_path):
    text = 'Attributes, filename ,Extra\nD,a\\\n,"b ""q"".txt",1\nA\n,"",\n,".hid"\n'
    found = {r["path"]: r for r in rows(read_file_list(spark, write(tmp_path / "b.efu", text)))}
    assert set(found) == {"a", 'b "q".txt', ".hid"}
    assert found[".hid"]["hidden"] and found["a"]["kind"] == "directory" and found['b "q".txt']["size"] == 0


def test_file_list_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "c.efu", 'Filename,Size\n"a\nb.txt",3\nc.txt,4\n')
    assert {(r["path"], r["size"]) for r in rows(read_file_list(spark, path))} == {("a\nb.txt", 3), ("c.txt", 4)}


def test_file_list_rejections(spark, tmp_path):
    with pytest.raises(CatalogError, match="Filename"):
        read_file_list(spark, write(tmp_path / "d.efu", "Name,Size\na,1\n"))
    repeated = read_file_list(spark, write(tmp_path / "e.efu", "Filename\na\na/\nb\n"))
    assert [r["path"] for r in rows(repeated_paths(repeated))] == ["a"]


CASES = [
    (["*.md"], {"a.md", "d/b.md"}),
    (["d/**"], {"d", "d/b.md", "d/x", "d/x/y.txt"}),
    (["x"], {"d/x", "d/x/y.txt"}),
    (["d/*"], {"d/b.md", "d/x", "d/x/y.txt"}),
    (["?.md"], {"a.md", "d/b.md"}),
    (["[a-b].md", "[!z"], {"a.md", "d/b.md"}),
    (["[^a].md"], {"d/b.md"}),
    (["[]a]", "[-x]", "a\\"], set()),
    (["\\d"], {"d", "d/b.md", "d/x", "d/x/y.txt"}),
    ([" ", ""], set()),
    (["d*/x"], {"d/x", "d/x/y.txt"}),
    (["d*/**"], {"d/b.md", "d/x", "d/x/y.txt"}),
    (["D"], set()),
    (["star[*]"], {"star*"}),
]


@pytest.mark.parametrize("patterns, dropped", CASES)
def test_globs(spark, patterns, dropped):
    paths = ["a.md", "d", "d/b.md", "d/x", "d/x/y.txt", "e", "dd", "star*"]
    kept = exclude_globs(spark.createDataFrame([(p,) for p in paths], "path string"), patterns)
    assert set(paths) - {r["path"] for r in rows(kept)} == dropped


def test_no_usable_glob():
    assert exclusion_regex(["", "  "]) is None


@pytest.fixture
def tree(tmp_path):
    for name, content in {
        "keep/nested/Report.PDF": b"report", "keep/.hidden": b"", "skip-me/secret.txt": b"no", "keep/nested/big.bin": b"x" * 70000,
    }.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    os.symlink("nested", tmp_path / "keep/link")
    (tmp_path / "empty").mkdir()
    return tmp_path


@pytest.mark.parametrize("budget", [1, 1000])
def test_inventory(spark, tree, budget):
    found = file_inventory(spark, str(tree), exclude=["skip-me/**"], hash_mode="full", folders_per_task=budget)
    by_path = {r["path"]: r for r in rows(inventory_entries(found))}
    kinds = {p: r["kind"] for p, r in by_path.items()}
    assert kinds == {
        "keep": "directory", "empty": "directory", "keep/nested": "directory", "keep/nested/Report.PDF": "file",
        "keep/.hidden": "file", "keep/nested/big.bin": "file", "keep/link": "symlink",
    }
    report = by_path["keep/nested/Report.PDF"]
    assert report["extension"] == "pdf" and report["hash"] == "sha256:" + hashlib.sha256(b"report").hexdigest()
    assert by_path["keep/.hidden"]["hidden"] and by_path["keep/link"]["hash"] == ""
    assert rows(inventory_summary(found)) == [{"files": 3, "directories": 3, "bytes": 70006, "errors": 0}]


def test_inventory_quick_hash_and_errors(spark, tree, monkeypatch):
    found = file_inventory(spark, str(tree), hash_mode="quick")
    data = b"x" * 70000
    quick = hashlib.sha256(len(data).to_bytes(8, "little") + data[:65536] + data[65536:]).hexdigest()
    assert {r["hash"] for r in rows(found.where("name = 'big.bin'"))} == {"quick:" + quick}
    from_rows = {r["hash"] for r in rows(binary_fingerprints(spark, str(tree / "keep/nested"), "quick").where("size = 70000"))}
    assert from_rows == {"quick:" + quick}
    # A file that vanishes between listing and hashing is kept without a hash and counted.
    lost = file_inventory(spark, str(tree), hash_mode="full")
    (tree / "keep/nested/big.bin").unlink()
    kept = rows(lost.where("name = 'big.bin'"))
    assert kept[0]["hash"] == "" and "No such file" in kept[0]["error"]
    assert rows(inventory_summary(lost))[0]["errors"] == 1


def test_inventory_rejections(spark, tree):
    with pytest.raises(CatalogError):
        file_inventory(spark, str(tree / "keep/.hidden"))
    with pytest.raises(CatalogError):
        file_inventory(spark, str(tree), hash_mode="md5")


def test_progress_counters(spark, tree):
    progress = Observation("scan")
    found = observed(file_inventory(spark, str(tree)), progress)
    found.where(F.col("kind") != "").write.format("noop").mode("overwrite").save()
    assert progress.get == {"files": 4, "directories": 4, "bytes": 70008, "errors": 0}
