from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from archidex.schema import DRIVES, ENTRIES, IMPORTS, SNAPSHOTS, Catalog, conform  # noqa: E402
from archidex.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def entry(snapshot_id, path, size=0, modified_at=0, hash_="", kind="file"):
    parent, _, name = path.rpartition("/")
    extension = name.rpartition(".")[2].lower() if "." in name and kind == "file" else ""
    return {
        "snapshot_id": snapshot_id, "path": path, "parent_path": parent, "name": name, "extension": extension,
        "kind": kind, "size": size, "modified_at": modified_at, "hash": hash_, "hidden": name.startswith("."),
    }


def frame(spark, rows, schema):
    names = [f.name for f in schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def catalog_of(spark, drives, snapshots, entries, imports=(), version=2, location=None):
    """A catalog from plain dicts; counters of complete snapshots are filled in unless given."""
    full_drives = [
        {"source_path": "", "location": "", "notes": "", "tags": [], "fingerprint": "", "created_at": 1, "updated_at": 1, **d}
        for d in drives
    ]
    rows = []
    for s in snapshots:
        own = [e for e in entries if e["snapshot_id"] == s["id"]]
        files = [e for e in own if e["kind"] == "file"]
        rows.append({
            "source_path": "/m", "status": "complete", "hash_mode": "full", "file_count": len(files),
            "directory_count": sum(e["kind"] == "directory" for e in own), "total_bytes": sum(e["size"] for e in files),
            "error_count": 0, "started_at": 100, "completed_at": 110, "failure": "", **s,
        })
    numbered = [{"id": i, **e} for i, e in enumerate(entries, start=1)]
    return Catalog(
        frame(spark, full_drives, DRIVES), frame(spark, rows, SNAPSHOTS), frame(spark, numbered, ENTRIES),
        frame(spark, imports, IMPORTS), version=version, location=location,
    )


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


__all__ = ["catalog_of", "conform", "entry", "frame", "rows"]
