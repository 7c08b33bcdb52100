"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.sources.shared import Scratch, fresh_path, shared_dir, small_or_shuffled, written

__all__ = ["BLANKS", "BLANK_RUN", "Scratch", "fresh_path", "let", "load", "n_words", "shared_dir", "small_batches", "small_or_shuffled", "words", "written"]

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+` words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Within it, tables go to Python in batches of up to `size`, so that a worker's memory is small whatever the texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The `[^\\x20\\x09-\\x0D]+` words of a text in order; none for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
