"""Tables from files, databases and views, and a probe of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, location: str, table: str | None = None, **options: str) -> DataFrame:
    """Rows of a Parquet folder, or, for a jdbc: location, of a database table read in ranges if options give a partition column."""
    if table is not None and (table.startswith("/") or ".." in table.split("/")):
        raise ValueError(f"a table outside of its folder: {table}")
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=location, dbtable=table, **options).load()
    return spark.read.parquet(f"{location}/{table}.parquet" if table else location)


def scan_either(spark: SparkSession, location: str | None, demo: str, table: str, **options: str) -> DataFrame:
    """A table of the outside database, if one is set, and else of the demo data."""
    return scan(spark, location or demo, table, **options)


def registered(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Contract views over whatever source holds them; queries name the views only."""
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)


def probe(spark: SparkSession, names: list[str]) -> DataFrame:
    """(view, rows): the number of rows of each view, null where there is no such view."""
    parts = [spark.table(n).agg(F.lit(n).alias("view"), F.count("*").alias("rows")) if spark.catalog.tableExists(n) else spark.range(1).select(F.lit(n).alias("view"), F.lit(None).cast("long").alias("rows")) for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def models(listing: DataFrame, without: str = "embed") -> DataFrame:
    """Names of a model listing (name), without empty ones and embedders, in order."""
    return listing.where((F.coalesce("name", F.lit("")) != "") & ~F.col("name").contains(without)).select("name").distinct().orderBy("name")
