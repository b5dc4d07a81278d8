"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from isoreach.registry import load  # noqa: E402
from isoreach.session import local_session  # noqa: E402

HEADLINE = (
    "L01_cumulative", "L02_nearest", "L06_access_wide", "L08_access_stats", "L09_nearest_stats", "L07_mode_ratio",
    "L13_zone_weights", "L14_points_lookup", "J02_fallback", "K01_point_in_zone", "K02_zone_or_nearest", "K04_within_10m",
    "K06_overlay_area", "K13_greenspace", "A10_profile", "W01_rank_cities", "S09_fanout",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    entries = load()
    names = sys.argv[1:] or HEADLINE
    # Start-up of the JVM and of code generation is no part of any query.
    entries["A06_distinct"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline query seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
