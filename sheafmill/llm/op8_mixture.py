"""Mixing sources to target weights.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share the whole of all words; a source's target stops
at three times its size, and what is cut is shared again by weight until none is above. That end state is a water level:
the sources with the least 3 * size / weight are capped, the others take weight * level. Each document is then emitted
floor(target / size) times, and once more if a hash of seed and doc_id falls below the fraction.

Defined cases: null text has size 0; an empty source has target 0; repeated rows draw alike; columns whose names begin with _sm_ are
reserved; no rows give none. Sources are few enough for windows over a row each to run in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafmill.llm import common

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: The table of targets has a row a source; up to so many rows it is broadcast, beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target from rows of (source, size). Windows run over one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everywhere = Window.partitionBy()
    per = per.withColumn("place", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())))
    pick = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") - 1) % len(weights) + 1)
    per = per.withColumn("weight", pick.cast("long")).withColumn("cap", most * F.col("source_size")).withColumn("total", F.sum("source_size").over(everywhere))
    per = per.withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
    order = everywhere.orderBy("full_at", "place")
    per = per.withColumn("rank", F.row_number().over(order))
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level_here", (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight"))
    per = per.withColumn("level", F.min_by("level_here", F.when(F.col("level_here") <= F.col("full_at"), F.col("rank"))).over(everywhere))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(F.col("level"), F.lit(0.0)))
    return per.select("source", "source_size", target.alias("target"))


def with_copies(rows: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """`rows` (doc_id, source ...) with _sm_source_size, _sm_target and _sm_copies, from `source_targets`, a row a source."""
    targets = common.small_or_shuffled(common.written(targets, "op8-targets"), BROADCAST_ROWS).select(F.col("source").alias("_sm_source"), F.col("source_size").alias("_sm_source_size"), F.col("target").alias("_sm_target"))
    out = rows.join(targets, rows["source"].eqNullSafe(targets["_sm_source"]))
    rate = F.when(F.col("_sm_source_size") > 0, F.col("_sm_target") / F.col("_sm_source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    copies = F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("_sm_copies", copies.cast("long")).drop("_sm_source")


def planned(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """`docs` with _sm_source_size, _sm_target and _sm_copies."""
    return with_copies(docs, source_targets(docs.select("source", common.n_words(F.col("text")).alias("size")), **kw), seed)


def mixed(docs: DataFrame, seed: str = SEED, **kw) -> DataFrame:
    """The mixture itself: the rows of `docs`, each as often as it is taken."""
    plan = planned(docs, seed, **kw).where("_sm_copies > 0")
    return plan.withColumn("_sm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_sm_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = common.load(spark, sf_dir, "documents").select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    sized = common.written(sized, "op8-sizes")
    plan = with_copies(sized, source_targets(sized))
    return plan.select("doc_id", "size", F.col("_sm_source_size").alias("source_size"), F.col("_sm_target").alias("target"), (F.col("size") * F.col("_sm_copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
q AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, sum(s) OVER ()::BIGINT AS total FROM p),
r AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * s AS cap FROM q),
t AS (SELECT *, cap::DOUBLE / weight AS full_at FROM r),
u AS (SELECT *, row_number() OVER o AS rank,
  coalesce(sum(cap) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight
  FROM t WINDOW o AS (ORDER BY full_at, place)),
v AS (SELECT *, (total - capped)::DOUBLE / open_weight AS level_here FROM u),
x AS (SELECT arg_min(level_here, rank) AS level FROM v WHERE level_here <= full_at),
g AS (SELECT source, s, least(cap::DOUBLE, weight * coalesce(level, 0.0)) AS target FROM v, x),
k AS (SELECT d.doc_id, d.size, g.s AS source_size, g.target, CASE WHEN g.s > 0 THEN g.target / g.s ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM k
"""
