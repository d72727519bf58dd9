"""Headline timings: prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs fully (``noop`` sink: every row is produced, nothing is
collected to the driver); one warm-up run, then the median of
``BENCH_REPEAT`` runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tripcast.plans import inputs  # noqa: E402
from tripcast.plans import queries as Q  # noqa: E402
from tripcast.session import local_session  # noqa: E402

HEADLINE = ["knn_nearest_vote", "knn_kth", "knn_voted", "knn_weighted", "knn_sweep", "nb_predict", "evaluate_by_k"]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * int(cpus))))))
    times: dict[str, float] = {}
    for name in HEADLINE:
        fn = Q.QUERIES[name]
        _run(fn(spark, sf_dir))  # warm-up
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            _run(fn(spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    # extra (not in the headline total): the pairs that listing all of a
    # person's past trips would make in the SQL form
    tr, te = inputs.sql_form_features(spark, sf_dir)
    n_pairs = (te.groupBy(F.col("out_id2").alias("out_id")).count().withColumnRenamed("count", "t")
               .join(tr.groupBy("out_id").count(), "out_id").agg(F.sum(F.col("t") * F.col("count"))).first()[0])
    extras = {"candidate_pairs_sql_form": int(n_pairs or 0)}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_headline_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "extras": extras,
    }))


if __name__ == "__main__":
    main()
