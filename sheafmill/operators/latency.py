"""Latencies as they are measured: each query of a set is run, timed, and its plan looked at."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURED = "name string, run long, ms double, plan_ok boolean"


def measured(spark: SparkSession, name: str, queries: Iterable[Callable[[], DataFrame]], expected: str, warm_up: int = 1) -> DataFrame:
    """(name, run, ms, plan_ok): a row a query, which is run to its last row; plan_ok tells whether `expected` stands in its plan. The first `warm_up` queries run
    once beforehand, unmeasured. What comes to the driver is a number a query."""
    rows, queries = [], list(queries)
    for query in queries[:warm_up]:
        query().write.format("noop").mode("overwrite").save()
    for run, query in enumerate(queries):
        df = query()
        plan_ok = expected in df._jdf.queryExecution().executedPlan().toString()
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        rows.append((name, run, 1000 * (time.perf_counter() - began), plan_ok))
    return spark.createDataFrame(rows, MEASURED)


def reported(rows: DataFrame) -> DataFrame:
    """(name, n, plan_ok, p50, p95, p99) in milliseconds, by the place min(n - 1, floor(p * n))."""
    from sheafmill.operators import ordering

    totals = rows.groupBy("name").agg(F.count("*").alias("n"), F.bool_and("plan_ok").alias("plan_ok"))
    return totals.join(ordering.percentiles(rows, "name", "ms", (50, 95, 99)), "name")
