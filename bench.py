"""Times the headline operators and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of local cores.
The catalog is derived from lineitem: two scans, close to twice its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from archidex.operators import browse, diff, duplicates, export, merge, search, stats
from archidex.plans import derive, registry
from archidex.session import build_session, cut_lineage, scratch_path
from archidex.sources.filelist import read_file_list
from archidex.sources.store import CatalogStore

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
BATCH = 1000


def timed(action, repeat: int = 1) -> float:
    """Best wall-clock seconds of the action; progress goes to stderr."""
    best = float("inf")
    for _ in range(repeat):
        started = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - started)
    print(f"{best:.3f}s", file=sys.stderr, flush=True)
    return round(best, 4)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": str(CPUS), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries: dict[str, float] = {}

    # The source rows are materialized first, so that ingest times the catalog's own work.
    lazy = derive.order_catalog(derive.table(spark, SF_DIR, "lineitem"))
    entries = cut_lineage(lazy.entries.repartition(2 * CPUS))
    source = lazy.with_(entries=entries, snapshots=cut_lineage(lazy.snapshots), drives=cut_lineage(lazy.drives))
    rows = source.entries.count()

    plain = CatalogStore(spark, scratch_path(spark, "bench-plain"), index=False)
    queries["ingest"] = timed(lambda: plain.publish(source, new_entries=source.entries))
    indexed = CatalogStore(spark, scratch_path(spark, "bench-indexed"))
    queries["ingest_indexed"] = timed(lambda: indexed.publish(source, new_entries=source.entries))
    catalog = indexed.load()
    name = catalog.entries.select("name").orderBy("path").head()[0]

    queries["search_unique"] = timed(lambda: search.search(catalog, f'"{name}"').collect(), 3)
    queries["search_path_term"] = timed(lambda: search.search(catalog, "part-1997").collect(), 3)
    queries["search_no_match"] = timed(lambda: search.search(catalog, "missingword").collect(), 3)
    queries["search_scan"] = timed(lambda: search.search_scan(catalog, "part-1997").collect(), 2)
    texts = [f"part-{i * 4 % 4096} r" if i % 2 else f"{i * 37}-1" for i in range(BATCH)]
    queries["search_batch_1000"] = timed(lambda: run(search.search_batch(catalog, texts, limit=20)), 2)

    queries["stats"] = timed(lambda: stats.stats(catalog).collect(), 2)
    queries["extension_stats"] = timed(lambda: stats.extension_stats(catalog).collect(), 2)
    queries["list_entries"] = timed(lambda: browse.list_entries(catalog, 2, "Archive/part-1997").collect(), 2)
    queries["duplicates"] = timed(lambda: run(duplicates.duplicates(catalog, limit=200)), 2)
    queries["diff_latest_two"] = timed(lambda: run(diff.diff_latest_two(catalog)), 2)
    queries["export_csv"] = timed(lambda: run(export.export_rows(catalog)), 2)
    queries["export_json"] = timed(lambda: run(export.export_json_lines(catalog)), 2)

    target = CatalogStore(spark, scratch_path(spark, "bench-target"), index=False)
    queries["merge_dry_run"] = timed(lambda: merge.merge_catalog(target, catalog, dry_run=True).report.collect())
    queries["merge"] = timed(lambda: merge.merge_catalog(target, catalog))
    queries["merge_repeat"] = timed(lambda: merge.merge_catalog(target, catalog))
    queries["merge_trust"] = timed(lambda: merge.merge_catalog(target, catalog, trust=True))

    lists = derive.written_file_lists(spark, SF_DIR)
    queries["read_efu"] = timed(lambda: run(read_file_list(spark, lists, strip_prefix="E:\\Archive")))
    queries["fingerprint_full"] = timed(lambda: run(registry.fingerprint_full(spark, SF_DIR)))
    queries["fingerprint_quick"] = timed(lambda: run(registry.fingerprint_quick(spark, SF_DIR)))

    size = sum(
        os.path.getsize(os.path.join(folder, file))
        for folder, _, files in os.walk(indexed.root.removeprefix("file:")) for file in files
    )
    print(json.dumps({
        "metric": "catalog_operators_total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
        "entries": rows,
        "ingest_entries_per_sec": round(rows / queries["ingest_indexed"]),
        "stored_bytes": size,
        "search_batch_ms_per_query": round(queries["search_batch_1000"] * 1000 / BATCH, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
