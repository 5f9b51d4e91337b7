"""Time the headline queries; prints one JSON line.

Every query runs once to warm the JVM and once for the clock; results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lettermark.plans.workbench import QUERIES, Workbench
from lettermark.session import local_session

HEADLINE = [
    "windowed_impact", "control_cohort", "citation_fields", "simpson_references", "field_normalised_impact",
    "cell_percentile_rank", "dual_trajectories", "cocitation", "journal_refs", "pair_counts", "pair_zscores", "paper_novelty",
    "career_histories", "career_features", "prepare_paper_match", "nearest_match", "embedding_similarity", "fuzzy_title_links",
]


def run(spark, folder: str, name: str) -> float:
    start = time.time()
    QUERIES[name](Workbench(spark, folder)).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    took = {}
    for name in names:
        run(spark, folder, name)
        took[name] = round(run(spark, folder, name), 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
