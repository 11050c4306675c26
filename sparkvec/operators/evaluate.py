"""Measures of a search: recall, latency percentiles, queries a second, for several sizes of the candidate list."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.errors import InvalidArgument
from sparkvec.operators import knn
from sparkvec.plans.saved import saved

#: The candidate list's sizes that figures to compare with are given for.
EF_SWEEP = (16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
COLUMNS = "engine string, ef_search long, `recall@10` double, p50_ms double, p99_ms double, qps double, build_or_train_s double"


def percentiles(times: DataFrame, column: str = "ms") -> DataFrame:
    """One row (p50_ms, p99_ms): exact percentiles, interpolated between neighbours; null for no rows."""
    return times.agg(F.percentile(column, F.lit(0.5)).alias("p50_ms"), F.percentile(column, F.lit(0.99)).alias("p99_ms"))


def measure(search: Callable[[DataFrame, int], DataFrame], queries: DataFrame, truth: DataFrame, k: int, engine: str, prepared: float, sizes: Iterable[int] = EF_SWEEP, alone: int = 20) -> DataFrame:
    """A row for each size: search(queries, size) is timed once over all queries, and for each of the first alone queries
    by itself; prepared are the seconds that building or training took. Times are of whole
    Spark jobs; without queries recall and percentiles are null."""
    if alone < 1:
        raise InvalidArgument("one query at least is timed alone")
    spark, n, rows = queries.sparkSession, queries.count(), []
    single = [queries.where(F.col("qid") == r["qid"]) for r in queries.select("qid").orderBy("qid").limit(alone).collect()]
    for size in sizes:
        took = []
        for one in single:
            began = time.perf_counter()
            search(one, size).collect()
            took.append(1000 * (time.perf_counter() - began))
        began = time.perf_counter()
        found = saved(search(queries, size), "found")
        wall = time.perf_counter() - began
        p50, p99 = (round(float(x), 4) for x in np.percentile(took, [50, 99])) if took else (None, None)
        share = round(knn.recall(found, truth, k).first()[0], 5) if n else None
        rows.append((engine, size, share, p50, p99, round(n / wall, 1), round(prepared, 2)))
    return spark.createDataFrame(rows, COLUMNS)


def write_csv(measured: DataFrame, path: str) -> None:
    """The rows as one CSV file with a header in a folder, ordered by engine and size."""
    measured.coalesce(1).sortWithinPartitions("engine", "ef_search").write.option("header", True).mode("overwrite").csv(path)
