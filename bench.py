"""Benchmark: run the headline catalogue queries at ``$BENCH_SF_DIR`` on
``local[$BENCH_CPUS]`` and print ONE JSON line.

Each query is executed completely through the ``noop`` sink (no result is
collected on the driver).  ``BENCH_QUERIES`` (comma separated) overrides the
headline list; ``BENCH_SF_DIR`` defaults to /root/testdata/sf0.1.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "lines_first_dim", "lines_three_way", "line_counts", "class_counts", "constant_columns",
    "knn_neighbors", "knn_predict", "audit", "eval_metrics", "knn_vectors",
    "tfidf_weights", "text_topk", "temporal_topk", "cv_scores", "score_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from ledgerlens.plans import load_all
    from ledgerlens.session import get_spark

    spark = get_spark(app="ledgerlens-bench", master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    queries, _ = load_all()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        df = queries[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"[bench] {name}: {times[name]:.2f}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
