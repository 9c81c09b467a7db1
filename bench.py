"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
cores, BENCH_QUERIES a comma-separated list of names or prefixes.  Each query is run
to completion once, with its result thrown away, after one unrelated warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veritab.queries import all_queries  # noqa: E402
from veritab.session import build_session  # noqa: E402

HEADLINE = [
    "h1_histogram_intersection", "h2_histogram_summary", "h3_jaccard_similarity", "h4_column_correlation", "h5_wasserstein_distance",
    "h6_jensen_shannon_distance", "h7_cumulative_difference", "h9_pairwise_similarity", "h10_association_matrix", "h12_correlation_accuracy",
    "h13_exact_duplicates", "h14_kway_aligned", "h15_kway_fitted", "h16_oov_summary", "h17_label_drift", "d3_joint_frequency",
    "d8_quantile_edges", "e1_percent_rank01", "i6_profile_numeric", "i7_row_labels", "t1_serialize_great", "t3_deserialize_last", "b12_repair_rows",
    "k6_sample_from_profile", "k7_sequential_generate", "k9_impute_rows", "k11_stratified_split", "p3_privacy_ledger", "n3_pivot_efficacy",
    "st1_generation_monitor",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [p for p in os.environ.get("BENCH_QUERIES", "").split(",") if p]
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()
    available = all_queries()
    names = [n for n in available if any(n.startswith(p) for p in wanted)] if wanted else HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        available[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
