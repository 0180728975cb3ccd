"""Headline timings: builds an index over events and over conversations, looks pairs up, and reports one JSON line."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reachspan.operators import algebra, dindex, graph
from reachspan.plans import derived
from reachspan.plans.queries import QUERIES
from reachspan.runtime import checkpoint_folder
from reachspan.sources import storage
from reachspan.sources.generate import random_pairs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["to_ranges", "multiply", "power_3", "dindex", "dindex_from_zero", "dindex_stepwise", "merge", "compress", "lookup"]
REACH = (128, 256, 512, 1024)
PAIRS = 1_000_000


def timed(df) -> tuple[float, int]:
    begun = time.perf_counter()
    n = df.count()
    return time.perf_counter() - begun, n


def stored(spark, index, d2: int) -> int:
    """Bytes of the index as it is saved."""
    path = f"{checkpoint_folder(spark)}/bench-{d2}-{uuid.uuid4().hex}"
    storage.save(index, path)
    return storage.size_in_bytes(spark, path)


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times, sizes = {}, {}
    QUERIES["nnz"](spark, SF_DIR).collect()  # starts the JVM's own work
    for name in NAMES:
        begun = time.perf_counter()
        _, sizes[name] = timed(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - begun, 3)
    a = graph.range_adjacency_matrix(derived.conversations_graph(spark, SF_DIR))
    a = algebra._written(a)
    for d2 in REACH:
        begun = time.perf_counter()
        index = dindex.create_distance_index(a, 0, d2)
        s = index.df.agg(F.count("*").alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("nnz")).first()
        times[f"conversations_{d2}"] = round(time.perf_counter() - begun, 3)
        seconds, _ = timed(dindex.query(index, random_pairs(spark, index.nrows, PAIRS)).where("hit"))
        times[f"lookup_{d2}_1m_pairs"] = round(seconds, 3)
        sizes[f"conversations_{d2}"] = {"ranges": s.ranges, "nnz": s.nnz, "ns_a_pair": round(seconds * 1e9 / PAIRS), "bytes": stored(spark, index, d2)}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS, "sizes": sizes}))
    spark.stop()


if __name__ == "__main__":
    main()
