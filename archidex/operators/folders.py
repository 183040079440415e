"""Digests of folders, and comparison by descent.

The digest of a folder follows from the entries in it and from the digests of
the folders in it, so the root's digest names a whole snapshot with the
strength of SHA-256, and two folders with equal digests need no comparison.
Entries are reduced to one row per folder in one pass; only folders then go up
by depth. The name and fields of an entry count, its place does not: a
folder keeps its digest when it moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.functions.paths import ancestors, base_name, parent_of
from archidex.operators.diff import compare
from archidex.operators.digest import framed
from archidex.schema import BROADCAST_ROWS, Catalog
from archidex.session import cut_lineage, scratch_path

# Children hashed in one go. Those of larger folders are first hashed in groups by the leading hex digits of their
# names' hashes, three digits (4,096 groups) a step, so that no group grows with its folder.
FAN = 4096
STEP = 3
STEPS = 3

_FIELDS = ("name", "extension", "kind", "size", "modified_at", "hash", "hidden")


def _hashed(children: DataFrame, keys: list[Column | str]) -> DataFrame:
    """One digest per group: the nodes in order of place, then node."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "node")))
    text = F.array_join(F.transform(ordered, lambda child: child["node"]), "")
    return children.groupBy(*keys).agg(F.sha2(text, 256).alias("node"), F.sum("entries").alias("entries"))


def _large(children: DataFrame, fan: int) -> DataFrame | None:
    """(snapshot_id, path, steps) of folders with more children than are hashed in one go; None without any."""
    keys = ["snapshot_id", "path"]
    counted = cut_lineage(children.groupBy(*keys).count().where(F.col("count") > fan))
    found = counted.count()
    if not found:
        return None
    steps = sum((F.col("count") > F.lit(float(fan) * float(16**STEP) ** n)).cast("int") for n in range(STEPS))
    sized = counted.select(*keys, steps.alias("steps"))
    return F.broadcast(sized) if found <= BROADCAST_ROWS else sized


def _by_folder(children: DataFrame, large: DataFrame | None) -> DataFrame:
    """(snapshot_id, path, node, entries) of folders from (snapshot_id, path, name, node) of their children."""
    keys = ["snapshot_id", "path"]
    placed = children.select(*keys, F.sha2("name", 256).alias("place"), "node", F.lit(1).cast("long").alias("entries"))
    if large is None:
        return _hashed(placed, keys)
    sized = placed.join(large, keys, "left").fillna(0, ["steps"])
    for step in range(STEPS, 0, -1):
        grouped = _hashed(
            sized.where(F.col("steps") >= step).withColumn("group", F.left("place", F.lit(STEP * step))),
            [*keys, "steps", "group"],
        ).withColumnRenamed("group", "place")
        sized = sized.where(F.col("steps") < step).unionByName(grouped)
    return _hashed(sized, keys)


def _depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def folder_digests(entries: DataFrame, fan: int = FAN) -> DataFrame:
    """(snapshot_id, path, depth, level, entries, digest) of every folder, the root with path "".

    ``level`` covers what is directly in the folder, ``digest`` all below it as
    well; ``entries`` counts what is directly in it. A folder without entries of
    its own has the level of no text. Folders without a row of their own, known
    only from paths, count too. A snapshot without entries has no folder.
    Repeated rows count as often as they occur.
    """
    spark = entries.sparkSession
    node = F.sha2(framed(*[F.col(c) for c in _FIELDS]), 256).alias("node")
    children = entries.select("snapshot_id", F.col("parent_path").alias("path"), "name", node)
    levels = cut_lineage(_by_folder(children, _large(children, fan)).withColumnRenamed("node", "level"))

    named = entries.where(F.col("kind") == "directory").select("snapshot_id", "path").unionAll(levels.select("snapshot_id", "path"))
    above = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), ancestors(F.col("path"))))
    known = named.distinct().select("snapshot_id", F.explode(above).alias("path")).distinct()
    folders = known.join(levels, ["snapshot_id", "path"], "left").select(
        "snapshot_id", "path", _depth(F.col("path")).alias("depth"),
        F.coalesce("level", F.sha2(F.lit(""), 256)).alias("level"), F.coalesce("entries", F.lit(0)).alias("entries"),
    )
    place = scratch_path(spark, "folders")
    folders.write.partitionBy("depth").parquet(place)
    folders = spark.read.schema(folders.schema).parquet(place)

    large = _large(folders.where(F.col("path") != "").select("snapshot_id", parent_of(F.col("path")).alias("path")), fan)
    rounds: list[DataFrame] = []
    for depth in range(_deepest(folders), -1, -1):
        at = folders.where(F.col("depth") == depth)
        below = F.lit("")
        if rounds:
            child = F.sha2(framed(base_name(F.col("path")), F.col("digest")), 256).alias("node")
            children = rounds[-1].select("snapshot_id", parent_of(F.col("path")).alias("path"), base_name(F.col("path")).alias("name"), child)
            inner = _by_folder(children, large).select("snapshot_id", "path", F.col("node").alias("below"))
            at, below = at.join(inner, ["snapshot_id", "path"], "left"), F.coalesce("below", F.lit(""))
        digest = F.sha2(F.concat("level", below), 256).alias("digest")
        rounds.append(cut_lineage(at.select("snapshot_id", "path", "depth", "level", "entries", digest)))
    return reduce(DataFrame.unionAll, rounds or [folders.select("snapshot_id", "path", "depth", "level", "entries", F.lit("").alias("digest"))])


def _deepest(folders: DataFrame) -> int:
    return folders.agg(F.coalesce(F.max("depth"), F.lit(-1))).head()[0]


def changed_folders(folders: DataFrame, from_id: int, to_id: int) -> DataFrame:
    """(path, depth, read, differs) of the folders a descent looks at in two snapshots.

    A folder is looked at if the folder above it has unequal digests.
    ``differs`` says whether its own has too, so that the descent goes on;
    ``read`` whether what is directly in it differs.
    """
    columns = ("path", "depth", "level", "digest")
    sides = [folders.where(F.col("snapshot_id") == i).select(*columns) for i in (from_id, to_id)]
    rounds: list[DataFrame] = []
    still_open = 1
    for depth in range(_deepest(folders) + 1):
        old, new = (side.where(F.col("depth") == depth) for side in sides)
        if rounds:
            open_above = rounds[-1].where("differs").select(F.col("path").alias("above"))
            open_above = F.broadcast(open_above) if still_open <= BROADCAST_ROWS else open_above
            under = parent_of(F.col("path")) == F.col("above")
            old, new = (side.join(open_above, under, "left_semi") for side in (old, new))
        pair = old.select("path", F.struct("level", "digest").alias("old")).join(
            new.select("path", F.struct("level", "digest").alias("new")), "path", "full_outer"
        )
        seen = cut_lineage(pair.select(
            "path", F.lit(depth).alias("depth"),
            (~F.col("old.level").eqNullSafe(F.col("new.level"))).alias("read"),
            (~F.col("old.digest").eqNullSafe(F.col("new.digest"))).alias("differs"),
        ))
        rounds.append(seen)
        still_open = seen.where("differs").count()
        if not still_open:
            break
    if not rounds:
        return folders.select("path", "depth", F.lit(False).alias("read"), F.lit(False).alias("differs"))
    return reduce(DataFrame.unionAll, rounds)


def diff_by_descent(catalog: Catalog, from_id: int, to_id: int, folders: DataFrame | None = None) -> DataFrame:
    """The rows of ``diff_all``; only entries of folders whose level differs are read and joined.

    ``folders`` are stored digests of both snapshots; without them they are
    made here, which costs the pass that a plain comparison needs.
    """
    both = catalog.entries.where(F.col("snapshot_id").isin(from_id, to_id))
    folders = folder_digests(both) if folders is None else folders.where(F.col("snapshot_id").isin(from_id, to_id))
    wanted = changed_folders(folders, from_id, to_id).where("read").select(F.col("path").alias("parent_path"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    inside = both.join(wanted, "parent_path", "left_semi")
    old, new = (inside.where(F.col("snapshot_id") == i) for i in (from_id, to_id))
    return compare(old, new, ["path"])


def descent_report(folders: DataFrame, from_id: int, to_id: int) -> DataFrame:
    """One row: folders and entries of both snapshots, those that a descent looks at, and those whose entries it reads."""
    pair = folders.where(F.col("snapshot_id").isin(from_id, to_id))
    # One row per folder of the pair on the left, at most one on the right.
    looked = pair.join(changed_folders(folders, from_id, to_id).select("path", "read"), "path", "left")
    read = F.coalesce("read", F.lit(False))
    return looked.agg(
        F.count(F.lit(1)).alias("folders"),
        F.count("read").alias("folders_seen"),
        F.count_if(read).alias("folders_read"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum(F.when(read, F.col("entries"))), F.lit(0)).alias("entries_read"),
    )
