"""Catalog versions as Parquet tables behind one manifest.

A version becomes visible when its manifest is renamed into place, after all
data it names has been written; readers follow the newest manifest only.

    manifests/v00000007.json      what belongs to version 7
    drives/v00000007/             small tables, rewritten per version
    snapshots/v00000007/
    imports/v00000007/
    entries/batch=7/snapshot_id=N one batch per commit, shared by later versions; a name only where it is not the end of the path
    postings/batch=7/             token index of the same batch
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archidex.functions.fingerprints import packed, unpacked
from archidex.functions.paths import base_name
from archidex.operators import lifecycle
from archidex.operators.postings import build_postings, postings_stats, sorting_tasks
from archidex.schema import (
    BROADCAST_ROWS,
    DRIVES,
    ENTRIES,
    IMPORTS,
    KINDS,
    POSTINGS,
    SCHEMA_VERSION,
    SNAPSHOTS,
    Catalog,
    CatalogError,
    conform,
    empty,
)
from archidex.session import cut_lineage, shuffles_freed

_SMALL = {"drives": DRIVES, "snapshots": SNAPSHOTS, "imports": IMPORTS}
_PAIRS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("snapshot_id", T.LongType())])
_ENTRY_FILE_ROWS = 5_000_000
# Pages of the second version hold ids and sorted paths as differences.
_COMPACT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


@dataclass(frozen=True)
class Manifest:
    version: int
    schema_version: int
    batches: tuple[int, ...]
    superseded: tuple[int, ...]  # versions that wrote a table of replaced (batch, snapshot) pairs
    indexed: tuple[int, ...]
    rows: dict[str, int]
    last_entry: int = 0
    superseded_rows: int = 0

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> "Manifest":
        raw = json.loads(text)
        return Manifest(
            version=raw["version"],
            schema_version=raw["schema_version"],
            batches=tuple(raw["batches"]),
            superseded=tuple(raw["superseded"]),
            indexed=tuple(raw["indexed"]),
            rows=dict(raw["rows"]),
            last_entry=raw.get("last_entry", 0),
            superseded_rows=raw.get("superseded_rows", 0),
        )


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def _unnamed(entries: DataFrame) -> DataFrame:
    """Entries as they are stored: a name that is the end of its path, as nearly all are, is left out."""
    return entries.withColumn("name", F.when(F.col("name") != base_name(F.col("path")), F.col("name")))


def _named(stored: DataFrame) -> DataFrame:
    """The entries that ``_unnamed`` made the rows from."""
    return stored.withColumn("name", F.coalesce(F.col("name"), base_name(F.col("path"))))


def check_schema_version(version: object) -> int:
    """An integer from 1 to the supported version, or an error."""
    try:
        number = int(str(version))
    except ValueError:
        number = 0
    if number < 1:
        raise CatalogError(f"invalid catalog schema version {version!r}")
    if number > SCHEMA_VERSION:
        raise CatalogError(f"catalog schema version {number} is newer than supported version {SCHEMA_VERSION}")
    return number


class CatalogStore:
    """One catalog folder on a file system that all executors share. Single writer."""

    def __init__(self, spark: SparkSession, root: str, index: bool = True):
        self.spark = spark
        self.root = root.rstrip("/")
        self.index = index
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files ---------------------------------------------------------------

    def _path(self, relative: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}" if relative else self.root)

    def resolved_root(self) -> str:
        return self._fs.makeQualified(self._path("")).toString()

    def _manifest_versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(name[1:-5]) for name in names if name.startswith("v") and name.endswith(".json"))

    def manifest(self) -> Manifest | None:
        versions = self._manifest_versions()
        if not versions:
            return None
        return Manifest.from_json(self.spark.read.text(self._manifest_path(versions[-1]), wholetext=True).head()[0])

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}.json"

    def _publish(self, manifest: Manifest) -> None:
        final = self._path(f"manifests/v{manifest.version:08d}.json")
        staged = self._path(f"manifests/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path("manifests"))
        out = self._fs.create(staged, False)
        out.write(bytearray(manifest.to_json().encode("utf-8")))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise CatalogError(f"catalog version {manifest.version} was published by another writer")

    # -- reading -------------------------------------------------------------

    def exists(self) -> bool:
        return bool(self._manifest_versions())

    def load(self) -> Catalog:
        manifest = self.manifest()
        if manifest is None:
            raise CatalogError(f"no catalog at {self.root}")
        check_schema_version(manifest.schema_version)
        small = {
            name: self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{manifest.version:08d}")
            if name in manifest.rows
            else empty(self.spark, schema)
            for name, schema in _SMALL.items()
        }
        postings, stats = self._postings(manifest)
        return Catalog(
            **small,
            entries=self._entries(manifest),
            version=manifest.schema_version,
            location=self.resolved_root(),
            drive_rows=manifest.rows.get("drives"),
            snapshot_rows=manifest.rows.get("snapshots"),
            postings=postings,
            postings_stats=stats,
        )

    def _batches(self, table: str, schema: T.StructType, batches: Iterable[int]) -> DataFrame:
        """The stored rows of the given batches, with their batch."""
        paths = [f"{self.root}/{table}/batch={batch}" for batch in batches]
        if not paths:
            return empty(self.spark, _with_batch(schema))
        return self.spark.read.schema(_with_batch(schema)).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def _entries(self, manifest: Manifest) -> DataFrame:
        """Entries without those that a later batch replaces: a left anti join with the table of replaced snapshots."""
        rows = _named(self._batches("entries", ENTRIES, manifest.batches))
        if manifest.superseded_rows:
            rows = rows.join(self._replaced_pairs(manifest), ["batch", "snapshot_id"], "left_anti")
        return rows.select(*(f.name for f in ENTRIES))

    def _pairs(self, table: str, versions: Iterable[int]) -> DataFrame:
        paths = [f"{self.root}/{table}/v{version:08d}" for version in versions]
        return self.spark.read.schema(_PAIRS).parquet(*paths) if paths else self.spark.createDataFrame([], _PAIRS)

    def _replaced_pairs(self, manifest: Manifest) -> DataFrame:
        pairs = self._pairs("superseded", manifest.superseded)
        return F.broadcast(pairs) if manifest.superseded_rows <= BROADCAST_ROWS else pairs

    def _postings(self, manifest: Manifest) -> tuple[DataFrame | None, DataFrame | None]:
        """The token index of all batches; those written without one are tokenized when they are searched."""
        if not manifest.indexed:
            return None, None
        paths = [f"{self.root}/postings_stats/batch={batch}" for batch in manifest.indexed]
        postings = self._batches("postings", POSTINGS, manifest.indexed).drop("batch")
        stats = self.spark.read.schema("docs long, tokens long").parquet(*paths)
        # Odd batches replace entries of earlier ones and repeat their texts.
        plain = [batch for batch in manifest.batches if batch % 2 == 0 and batch not in manifest.indexed]
        if plain:
            entries = _named(self._batches("entries", ENTRIES, plain).drop("batch"))
            postings = postings.unionByName(conform(build_postings(entries), POSTINGS))
            stats = stats.unionByName(postings_stats(entries))
        return postings, stats

    # -- writing -------------------------------------------------------------

    def _write_small(self, version: int, tables: dict[str, DataFrame]) -> dict[str, int]:
        rows = {}
        for name, schema in _SMALL.items():
            path = f"{self.root}/{name}/v{version:08d}"
            conform(tables[name], schema).write.mode("overwrite").parquet(path)
            rows[name] = self.spark.read.schema(schema).parquet(path).count()
        return rows

    def _checked(self, entries: DataFrame, last_entry: int, laid: bool) -> DataFrame:
        """Entries in the order they are stored in, with ids; one that breaks a rule is an error when it is read."""
        keys = ["snapshot_id", "parent_path", "path"]
        ordered = conform(entries, ENTRIES)
        if not laid:
            ordered = ordered.withColumn("hash", packed(F.col("hash"))).repartitionByRange(*keys)
        seen = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
        problem = (
            F.when(F.col("snapshot_id").isNull(), "entry of an unknown scan")
            .when(reduce(Column.__or__, (F.col(f.name).isNull() for f in ENTRIES if f.name != "id")), "entry with a missing value")
            .when(~F.col("kind").isin(*KINDS), "entry of an unknown kind")
            .when(F.col("_seen") > 1, "path listed twice in one snapshot")
        )
        refused = F.raise_error(F.concat(problem, F.lit(": "), F.coalesce("path", F.lit(""))))
        number = F.lit(last_entry + 1).cast("long") + F.monotonically_increasing_id()
        return (
            ordered.withColumn("_seen", seen)
            .withColumn("path", F.when(problem.isNotNull(), refused.cast("string")).otherwise(F.col("path")))
            .drop("_seen")
            .withColumn("hash", F.col("hash") if laid else unpacked(F.col("hash")))
            .withColumn("id", F.coalesce(F.col("id"), number))
        )

    def _write_entries(self, batch: int, entries: DataFrame, last_entry: int, laid: bool = False) -> DataFrame:
        """Write one batch and return it as stored; rows without an id get ids above ``last_entry``.

        The range layout splits a large snapshot, or a large folder in it,
        over many files and keeps a folder's rows together, so that a folder
        page reads few row groups. The same layout puts equal paths side by
        side, which makes the uniqueness check free of another shuffle.
        Fingerprints are most of a row; they pass the shuffle as bytes.
        Rows that are ``laid`` in ranges of folders and paths already stay
        where they are; should Spark not know that equal paths are together,
        it shuffles them for the check by itself.
        """
        path = f"{self.root}/entries/batch={batch}"
        with shuffles_freed(self.spark):
            (
                _unnamed(self._checked(entries, last_entry, laid)).write.mode("overwrite")
                .option("maxRecordsPerFile", _ENTRY_FILE_ROWS).options(**_COMPACT).partitionBy("snapshot_id").parquet(path)
            )
        return _named(self.spark.read.schema(ENTRIES).parquet(path))

    def _write_postings(self, batch: int, stored: DataFrame) -> None:
        path = f"{self.root}/postings/batch={batch}"
        keys = ["suffix", "snapshot_id", "entry_id"]
        stats_path = f"{self.root}/postings_stats/batch={batch}"
        postings_stats(stored).write.mode("overwrite").parquet(stats_path)
        # Tokens of names count twice here, so tasks get somewhat less than their share.
        tokens = self.spark.read.schema("docs long, tokens long").parquet(stats_path).agg(F.sum("tokens")).head()[0] or 0
        index = conform(build_postings(stored), POSTINGS)
        laid = index.repartitionByRange(sorting_tasks(tokens), *keys).sortWithinPartitions(*keys)
        with shuffles_freed(self.spark):
            laid.write.mode("overwrite").parquet(path)

    def publish(
        self,
        tables: Catalog | dict[str, DataFrame] | Callable[[DataFrame], Catalog],
        new_entries: DataFrame | None = None,
        replaced: DataFrame | None = None,
        counted: bool = False,
        schema_version: int = SCHEMA_VERSION,
        laid: bool = False,
    ) -> Catalog:
        """Write a new version: small tables, and entries of new or replaced snapshots.

        ``replaced`` holds full new contents of snapshots that already have
        entries (same ids, names and paths), so their postings stay valid.
        ``tables`` may be a function of the new entries as stored, for tables
        that are derived from them: the entries are then made only once.
        With ``counted`` the counters of the new snapshots are taken from the
        stored entries. The range layout samples its input before it reads it,
        so rows that are dear to make (a scan's listing and hashing, the join
        of a replacement) are written out first; those of a merge are not.
        New entries that are ``laid`` in ranges of folders and paths by their
        maker are not shuffled once more.
        """
        check_schema_version(schema_version)
        previous = self.manifest()
        version = 1 if previous is None else previous.version + 1
        batches = list(previous.batches) if previous else []
        indexed = list(previous.indexed) if previous else []
        superseded = list(previous.superseded) if previous else []
        superseded_rows = previous.superseded_rows if previous else 0
        if isinstance(tables, Catalog):
            tables = {name: getattr(tables, name) for name in _SMALL}
        if callable(tables) and new_entries is None:
            raise CatalogError("tables made from new entries need new entries")

        batch = 2 * version
        last_entry = previous.last_entry if previous else 0
        if new_entries is not None:
            rows = cut_lineage(conform(new_entries, ENTRIES)) if counted else new_entries
            stored = self._write_entries(batch, rows, last_entry, laid and not counted)
            last_entry = max(last_entry, stored.agg(F.max("id")).head()[0] or 0)
            if callable(tables):
                derived = tables(stored)
                tables = {name: getattr(derived, name) for name in _SMALL}
            if counted:
                tables = dict(tables, snapshots=lifecycle.apply_counters(tables["snapshots"], stored))
            if self.index:
                self._write_postings(batch, stored)
                indexed.append(batch)
            batches.append(batch)
        if replaced is not None:
            stored = self._write_entries(batch + 1, cut_lineage(conform(replaced, ENTRIES)), last_entry)
            self._stored_pairs(previous, stored).write.mode("overwrite").parquet(f"{self.root}/superseded/v{version:08d}")
            superseded.append(version)
            superseded_rows += self._pairs("superseded", [version]).count()
            batches.append(batch + 1)
            if self.index:
                # The rows keep their ids and texts, so only an empty index part is added.
                none = empty(self.spark, POSTINGS)
                none.write.mode("overwrite").parquet(f"{self.root}/postings/batch={batch + 1}")
                zero = self.spark.createDataFrame([(0, 0)], "docs long, tokens long")
                zero.write.mode("overwrite").parquet(f"{self.root}/postings_stats/batch={batch + 1}")
                indexed.append(batch + 1)
        rows = self._write_small(version, tables)
        manifest = Manifest(version, schema_version, tuple(batches), tuple(superseded), tuple(indexed), rows, last_entry, superseded_rows)
        self._publish(manifest)
        return self.load()

    def compact(self) -> Catalog:
        """Rewrite the entries of all batches as one, with the same ids, and publish that as a new version.

        Long histories of small commits leave many small batches, and replaced
        entries stay where they were; reads of the new version see neither.
        """
        manifest, catalog = self.manifest(), self.load()
        version = manifest.version + 1
        stored = self._write_entries(2 * version, catalog.entries, manifest.last_entry)
        if self.index:
            self._write_postings(2 * version, stored)
        rows = self._write_small(version, {name: getattr(catalog, name) for name in _SMALL})
        batches = (2 * version,)
        indexed = batches if self.index else ()
        self._publish(Manifest(version, manifest.schema_version, batches, (), indexed, rows, manifest.last_entry))
        return self.load()

    def expire(self, keep: int = 1) -> list[str]:
        """Delete all but the newest ``keep`` versions and the data that none of those names; returns the deleted folders.

        Who still reads an older version loses it, so call this when nobody does.
        """
        versions = self._manifest_versions()
        kept = versions[-max(keep, 1):]
        manifests = [Manifest.from_json(self.spark.read.text(self._manifest_path(v), wholetext=True).head()[0]) for v in kept]
        batches = {f"batch={b}" for m in manifests for b in (*m.batches, *m.indexed)}
        alive = {
            **{name: {f"v{v:08d}" for v in kept} for name in _SMALL},
            **{name: batches for name in ("entries", "postings", "postings_stats")},
            "superseded": {f"v{v:08d}" for m in manifests for v in m.superseded},
        }
        # Manifests go first: a version is gone as a whole before any of its data is.
        dead = [f"manifests/v{v:08d}.json" for v in versions if v not in kept]
        for folder, names in alive.items():
            if self._fs.exists(self._path(folder)):
                found = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
                dead += [f"{folder}/{name}" for name in sorted(found) if name not in names]
        for path in dead:
            self._fs.delete(self._path(path), True)
        return dead

    def _stored_pairs(self, previous: Manifest, replaced: DataFrame) -> DataFrame:
        """The (batch, snapshot) pairs that hold the replaced snapshots now. Partition values only; no entry is read."""
        stored = self._batches("entries", ENTRIES, previous.batches).select("batch", "snapshot_id").distinct()
        stored = stored.join(replaced.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
        if previous.superseded_rows:
            stored = stored.join(self._replaced_pairs(previous), ["batch", "snapshot_id"], "left_anti")
        return stored.select(*(f.name for f in _PAIRS))

    # -- operations ----------------------------------------------------------

    def initialize(self) -> Catalog:
        """Create an empty catalog, or open the existing one and fail stale scans."""
        if not self.exists():
            return self.publish({name: empty(self.spark, schema) for name, schema in _SMALL.items()})
        catalog = self.load()
        now = int(time.time())
        if catalog.version < SCHEMA_VERSION or not lifecycle.stale_snapshots(catalog.snapshots, now).isEmpty():
            snapshots = lifecycle.recover_stale(catalog.snapshots, now)
            catalog = self.publish(catalog.with_(snapshots=snapshots))
        return catalog

    def start_snapshots(self, headers: DataFrame) -> tuple[Catalog, DataFrame]:
        """Record scans that begin, so that a crash leaves a trace; the catalog, and the headers with their new ids."""
        catalog = self.initialize()
        numbered = cut_lineage(lifecycle.number_scans(catalog, headers))
        started = catalog.snapshots.unionByName(lifecycle.started_rows(numbered))
        return self.publish(catalog.with_(snapshots=started)), numbered

    def commit_snapshots(self, headers: DataFrame, entries: DataFrame, now: int | None = None) -> Catalog:
        """Commit finished scans of any number of drives as one new version.

        ``headers``: scan_key, drive_id, source_path, hash_mode, error_count,
        started_at. ``entries`` carry the scan_key they belong to. Counters
        come from the stored entries; every drive points to its new snapshot.
        The scans are first recorded as begun. If an entry belongs to none of
        them, lacks a value, has an unknown kind or repeats a path, the scans
        are recorded as failed, with the reason, and nothing of them is kept.
        """
        now = int(time.time()) if now is None else now
        catalog, numbered = self.start_snapshots(headers)
        try:
            ids = numbered.select("scan_key", F.col("id").alias("snapshot_id"))
            ids = F.broadcast(ids) if numbered.count() <= BROADCAST_ROWS else ids
            located = entries.drop("snapshot_id").join(ids, "scan_key", "left")
            snapshots = lifecycle.settled(catalog.snapshots, lifecycle.completed_rows(numbered, now))
            drives = lifecycle.point_to_latest(catalog.drives, numbered, now)
            return self.publish(catalog.with_(drives=drives, snapshots=snapshots), new_entries=located, counted=True)
        except Exception as error:
            reason = (str(error).splitlines() or [type(error).__name__])[0][:300]
            failed = lifecycle.failed_rows(numbered, reason, now)
            self.publish(catalog.with_(snapshots=lifecycle.settled(catalog.snapshots, failed)))
            raise

    def fail_snapshots(self, headers: DataFrame, message: str = "scan failed", now: int | None = None) -> Catalog:
        """Record scans that did not finish; nothing of them is readable."""
        now = int(time.time()) if now is None else now
        catalog = self.initialize()
        failed = lifecycle.failed_rows(lifecycle.number_scans(catalog, headers), message, now)
        return self.publish(catalog.with_(snapshots=catalog.snapshots.unionByName(failed)))
