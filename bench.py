"""Bench: headline queries over whole tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from vistagrid.plans import load_all
from vistagrid.session import local_session

HEADLINE = ["flagship_vibe_tiles", "tile_preference_scores", "request_weight_ratios", "ranked_tiles", "road_stress_tiles", "release_3_2", "release_3_7",
            "building_density", "landcover_green_urban", "analytics_summary", "daily_rollup", "weight_calibration", "duration_calibration",
            "profile_scores", "assigned_profiles", "distance_to_next", "release_validation", "debounced_tiles", "nearest_nodes", "contract_flags", "numbered_tiles"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    plans = load_all().QUERIES
    spent = {}
    for name in HEADLINE:
        start = time.time()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
    tiles = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    requests = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": os.path.basename(sf_dir).removeprefix("sf"),
                      "tiles_rescored_per_sec": round(tiles / spent["release_3_7"], 1), "requests_ranked_per_sec": round(requests / spent["ranked_tiles"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
