"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an optional
comma-separated choice. Every result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalogue  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "a1_read_labels b3_label_fingerprint c1_verified_counts c4_unlabelled_candidates c5_drop_reviewed_land "
    "d1_nearest_size_feedback d2_matched_vessels d3_duplicate_groups f3_top_unlabelled f3_review_queue f5_suppress "
    "e6_evaluate e7_performance_summary e12_static_vessels g4_pixel_to_lonlat g3_bearing c6_drop_static_sea "
    "d5_window_pixels e13_overview_grid e16_crop_features h7_stack_bands i2_spectral_match i15_spectral_fields "
    "j3_band_velocity j3_combine_pairs g11_hull_quad g12_keel_heading k1_decode_heads k6_fuse_heading k8_scene_queue "
    "l1_samples l5_weighted_draws"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "*"))
    # One small query first, so that the first timing does not include the start of the session.
    catalogue.QUERIES["c1_verified_counts"](spark, folder).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
