"""Counts and lists of a corpus overview, over chunks, messages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overview(chunks: DataFrame) -> DataFrame:
    """One row: totals, reviews by state, means, all in one pass."""
    state = lambda s: F.count_if(F.col("review") == s)
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("collection").alias("collections"), state("pending").alias("pending"), state("accepted").alias("accepted"), state("rejected").alias("rejected"),
        state("edited").alias("edited"), F.count("embedding").alias("embedded"), F.coalesce(F.round(F.avg("token_count")).cast("long"), F.lit(0)).alias("mean_tokens"),
        F.coalesce(F.min("token_count"), F.lit(0)).alias("least_tokens"), F.coalesce(F.max("token_count"), F.lit(0)).alias("most_tokens"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def by_collection(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"), F.count_if(F.col("review") == "accepted").alias("accepted"), F.count_if(F.col("embedding").isNotNull()).alias("embedded")).orderBy(F.desc("chunks"), "collection")


def grouped_counts(rows: DataFrame, *keys: Column | str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def with_counts(parents: DataFrame, children: DataFrame, key: str, *counts: Column) -> DataFrame:
    """Parents with counts of their children, 0 without any."""
    per = children.groupBy(key).agg(*counts)
    return parents.join(per, key, "left").fillna(0, [c for c in per.columns if c != key])


def latest_before(messages: DataFrame, answers: Column, asked: Column, thread: str = "conv_id", at: str = "turn") -> DataFrame:
    """Each answer with the latest asked text strictly before it in its thread. One window, no self join."""
    earlier = Window.partitionBy(thread).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("question", F.last(F.when(asked, F.col("text")), ignorenulls=True).over(earlier)).where(answers)


def gaps(messages: DataFrame, most: int = 10) -> DataFrame:
    """Answers without a [n] marker, the newest `most` first, then those of them that have a question."""
    found = latest_before(messages, (F.col("role") == "assistant") & ~F.col("text").rlike("\\[[0-9]+\\]"), F.col("role") == "user")
    newest = found.orderBy(F.desc("turn"), F.desc("conv_id")).limit(most)
    return newest.where("question IS NOT NULL").select("conv_id", "turn", F.substring("question", 1, 160).alias("question"), F.substring("text", 1, 240).alias("answer"))


def last_messages(messages: DataFrame, n: int = 8, trim: int = 300) -> DataFrame:
    """The last n of each thread but the newest, in order, long answers cut."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    text = F.when(F.col("role") == "assistant", F.substring("text", 1, trim)).otherwise(F.col("text"))
    kept = messages.withColumn("back", back).where((F.col("back") <= n) & (F.col("back") > 1))
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return kept.select("conv_id", "turn", "role", text.alias("text"), order.alias("place"))


def recency(at: Column, now: Column) -> Column:
    day = F.date_trunc("day", now)
    return F.when(at >= day, "today").when(at >= day - F.expr("INTERVAL 1 DAY"), "yesterday").when(at >= day - F.expr("INTERVAL 7 DAY"), "previous 7 days").otherwise("older")
