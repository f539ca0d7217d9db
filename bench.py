"""Times of the headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. Each stage of the scan is timed on
the stored result of the one before it, after one warm-up at the smallest scale.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from twinframe.operators.classify import classify  # noqa: E402
from twinframe.operators.similarity import similarity_components  # noqa: E402
from twinframe.operators.split import split_oversized  # noqa: E402
from twinframe.session import build_session, materialise  # noqa: E402
from workload import queries as q  # noqa: E402
from workload.derive import SETTINGS, features, kept_features  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
READERS = [
    "compare_roles", "merge_plan", "organise_plan", "trash_manifest", "collision_free_names", "false_positive_distances",
    "files_to_read", "cache_status", "folder_fingerprints", "filename_dates", "video_groups", "calibration_score",
    "guard_diagnosis", "csv_export",
]


def scan(spark, sf_dir, seconds):
    """Features, components, splitting and roles, one after the other."""

    def timed(name, build):
        started = time.time()
        out = materialise(build(), name)
        seconds[name] = round(time.time() - started, 3)
        return out

    timed("features", lambda: features(spark, sf_dir))
    f = kept_features(spark, sf_dir)
    components = timed("components", lambda: similarity_components(f, SETTINGS))
    split = timed("split", lambda: split_oversized(components, f, SETTINGS))
    roles = timed("roles", lambda: classify(split.filter("group_id is not null"), f, SETTINGS))
    timed("components_wide", lambda: similarity_components(f, q.WIDE))
    return f, components, roles


def main():
    spark = build_session("twinframe-bench", master=f"local[{CPUS}]", partitions=int(CPUS), driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    scan(spark, "/root/testdata/sf0.001", {})
    seconds: dict[str, float] = {}
    f, components, roles = scan(spark, SF_DIR, seconds)
    q.default_groups(spark, SF_DIR)
    for name in READERS:
        started = time.time()
        q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    n = f.count()
    facts = {
        "images": n, "linked": components.count(), "components": components.select("component").distinct().count(),
        "previews": roles.filter("role = 'preview'").count(),
        # The comparison cost the reference states: half a microsecond for each of n (n - 1) / 2 pairs.
        "all_pairs_estimate_sec": round(n * (n - 1) / 2 * 0.5e-6, 3),
        "largest_component": components.groupBy("component").count().agg(F.max("count")).first()[0],
    }
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(SF_DIR.rstrip("/")), "facts": facts}))


if __name__ == "__main__":
    main()
