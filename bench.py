"""Headline queries over stored observation tables; prints one JSON line.

The observation tables are derived from the test data and written once before
timing (``ingest`` seconds, reported apart).  Each query then runs in full into
a discarding sink, twice; the better time counts.  The figures compare our own
rounds; no published analytics timing exists to set against them.
"""
from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from rallygrid import fixtures
from rallygrid.plans.catalog import QUERIES, Tables

HEADLINE = [
    "shuttle_motion", "shuttle_motion_summary", "gap_caps", "interpolated_shuttle", "tracking_summary", "player_positions", "player_motion",
    "zone_seconds", "heatmap_seconds", "fragment_summary", "identified_players", "rally_summary", "doubles_pair_summary", "recovery",
    "projected_players", "players_in_region", "suppressed_boxes", "track_summary", "map_trails", "detection_evaluation", "shuttle_checks",
    "extracted_intervals", "normalized_timing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("rallygrid-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    t = Tables(spark, sf_dir)
    for name in fixtures.TABLES:
        if not name.startswith("fx_dirty") or name == "fx_dirty_shuttle":
            fixtures.table(spark, sf_dir, name)
    t.players, t.stored_motion  # noqa: B018 - pose observations and motion are stored as well
    ingest = time.perf_counter() - started
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "ingest": round(ingest, 3), "end_to_end": round(ingest + sum(times.values()), 3), "player_rows": t.positions.count(), "frames": t.frames.count()}))
    spark.stop()


if __name__ == "__main__":
    main()
