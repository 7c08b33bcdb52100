"""Row numbers and percentiles in groups of any size: range partitions, whose totals by group give each partition its offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafmill.sources import shared

#: A row a partition and group: broadcast up to so many, shuffled beyond.
BROADCAST_ROWS = 100_000


def with_offsets(rows: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """`rows` with _before: the summed weight (or number) of the rows before them in their group. The order must have no ties."""
    rows = rows.withColumn("_weight", F.lit(1).cast("long") if weight is None else F.col(weight).cast("long"))
    spread = shared.written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ordering")
    totals = spread.groupBy("_part", *by).agg(F.sum("_weight").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_of_{c}") for c in by]
    offsets = shared.written(totals.select(F.col("_part").alias("_of"), *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")), "ordering-offsets")
    same = spread["_part"] == F.col("_of")
    for c in by:
        same = same & spread[c].eqNullSafe(F.col(f"_of_{c}"))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    out = spread.join(shared.small_or_shuffled(offsets, BROADCAST_ROWS), same)
    return out.withColumn("_before", F.col("_offset") + F.col("_inside")).drop("_part", "_of", "_offset", "_inside", *[f"_of_{c}" for c in by])


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """`rows` with their number, from 1 on, in their group."""
    return with_offsets(rows, by, order).withColumn(name, F.col("_before") + 1).drop("_before", "_weight")


def percentiles(rows: DataFrame, by: str, value: str, percents: Sequence[int]) -> DataFrame:
    """(by, p<percent> ...): the value at place min(n - 1, floor(percent / 100 * n)) of each group's values in order. Equal values are
    counted before anything is ordered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    placed = with_offsets(counts, [by], [value], "_n")
    sizes = placed.groupBy(F.col(by).alias("_by")).agg(F.sum("_n").alias("_size"))
    placed = placed.join(sizes, placed[by].eqNullSafe(sizes["_by"]))
    at = {p: F.least(F.col("_size") - 1, F.floor(F.col("_size") * p / F.lit(100.0)).cast("long")) for p in percents}
    return placed.groupBy(by).agg(*[F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col(value))).alias(f"p{p}") for p, k in at.items()])
