"""Headline queries, timed; prints one JSON line.

Data comes from ``$BENCH_SF_DIR``, cores from ``$BENCH_CPUS``. Every query is
run to the end of its result (a no-op write), after one warm-up pass on the
same session, and the better of ``$BENCH_RUNS`` runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from foldgraph.plans import catalog  # noqa: E402

HEADLINE = [
    "edge_census", "records_from_df", "build_graphs", "expand_context", "reindex_nodes", "assign_shards",
    "check_graphs", "explode_nucleotides", "encode", "neighbour_sum", "build_graph_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, where: str) -> float:
        started = time.time()
        catalog.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return time.time() - started

    warm = f"{os.path.dirname(sf_dir)}/sf0.001"
    run("edge_census", warm if os.path.isdir(warm) else sf_dir)
    times = {name: round(min(run(name, sf_dir) for _ in range(runs)), 3) for name in names}
    spark.stop()
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
