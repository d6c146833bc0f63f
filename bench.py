"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Name prefixes
on the command line choose other queries; ``all`` runs every registered one.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prefmine.core import get_session  # noqa: E402
from prefmine.queries import load  # noqa: E402

HEADLINE = [
    "a04_hive_scan", "b02_validation_profile", "b14_vote_weight", "b16_stabilised_weight", "c04_active_only", "c09_shared_users", "c13_matrix_product",
    "d01_overview", "d05_counts_per_user", "d07_category_profile", "d17_rating_drift", "d25_length_by_rating", "d29_sparsity_metrics", "e01_long_tail",
    "e07_top_per_user", "g01_stratified_cap", "g05_oversample", "g06_popularity_inverse", "g11_ranking_negatives", "h01_k_core", "i01_review_tfidf",
    "i07_double_centred", "i09_decayed_profile", "j01_shrunk_means", "j04_item_cf", "k02_subset_scores", "k04_error_distribution", "k10_alpha_ablation",
    "l02_convex_grid", "m02_bags_of_words", "m10_affinity_variants", "m11_taste", "o01_stage_table", "p02_near_duplicates", "q01_user_stats_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    wanted = sys.argv[1:]
    if wanted == ["all"]:
        names = list(queries)
    elif wanted:
        names = [n for n in queries if any(n.startswith(w) for w in wanted)]
    else:
        names = HEADLINE
    spark = get_session("bench", cpus)
    queries["d08_verified"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
