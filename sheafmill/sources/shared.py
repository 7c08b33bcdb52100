"""Tables that cut a plan's lineage: written into the folder that all executors see, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes, by its rows' stated or measured width.
BROADCAST_BYTES = 64 << 20

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset a folder of our own, but in local mode alone: executors elsewhere wouldn't see it."""
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_dir = _local_dir or tempfile.mkdtemp(prefix="sheafmill-")
        base = f"file://{_local_dir}"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Puts a folder in the place of another, if there is one."""
    deleted(spark, to)
    source, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, at):
        raise OSError(f"{path} can't be moved to {to}")


class Scratch:
    """Paths of the written tables, so that those of a finished step can be deleted."""

    paths: list[str] = []

    @classmethod
    def delete(cls, spark: SparkSession, since: int, keep: int = 0) -> None:
        """Deletes the tables written after the first `since`, but for the last `keep`."""
        gone = cls.paths[since : len(cls.paths) - keep]
        for path in gone:
            deleted(spark, path)
            cls.paths.remove(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    Scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, most_rows: int, width: Column | None = None) -> DataFrame:
    """`df` (a written table of narrow rows) with a broadcast hint if it has at most `most_rows` rows, and, where rows vary in `width` (bytes),
    BROADCAST_BYTES; else unhinted, so that the join shuffles, and adaptive execution splits its hot keys."""
    if df.limit(most_rows + 1).count() > most_rows:
        return df
    if width is not None and (df.agg(F.sum(width)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)
