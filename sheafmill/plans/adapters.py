"""The driver's tables in the roles of the library's model: chunks, reviews, ledger, messages, jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a document: id, content, collection, lang, embedding (null while pending), review, reported, license, token_count."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return reviewed(spark, sf_dir, lambda docs: docs.join(vectors, "id", "left"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`chunks` without embeddings, for what reads texts: they meet no vectors, and so aren't shuffled for that. Only of an id that several vectors have there are as many rows."""
    repeated = shared.written(table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("_n")).where("_n > 1 AND id IS NOT NULL"), "repeated-vectors")
    if not repeated.limit(1).count():
        return reviewed(spark, sf_dir, lambda docs: docs)
    more = repeated.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_n"))
    return reviewed(spark, sf_dir, lambda docs: docs.join(more, "id", "left").drop("_n"))


def reviewed(spark: SparkSession, sf_dir: str, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = joined(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("collection"), "lang", "n_chars")).join(labels.withColumnRenamed("doc_id", "id"), "id", "left")
    review = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").otherwise("pending")
    license_ = F.when(F.regexp_extract("collection", "[0-9]+", 0).cast("int") % 3 == 0, "client-confidential").otherwise("internal")
    words = F.regexp_count(F.coalesce("content", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    vector = [c for c in ("embedding",) if c in out.columns]
    return out.select("id", "content", "collection", "lang", "n_chars", *vector, review.alias("review"), (F.coalesce("toxic", F.lit(0)) == 1).alias("reported"), license_.alias("license"), words.alias("token_count"))


#: The same for the oracle.
CHUNKS_SQL = r"""chunks AS (SELECT doc_id AS id, d.text AS content, source AS collection, lang, n_chars, embedding,
  CASE WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS review, coalesce(toxic, 0) = 1 AS reported,
  CASE WHEN regexp_extract(source, '[0-9]+')::INT % 3 = 0 THEN 'client-confidential' ELSE 'internal' END AS license,
  len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS token_count
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l USING (doc_id))"""


def cents(x: F.Column) -> F.Column:
    return F.round(x * 100).cast("long")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    gross = cents(F.col("o_totalprice"))
    rows = orders.select(F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("ref"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("issue_date"), F.col("o_orderstatus").alias("status"), gross.alias("gross"), F.when(F.col("o_orderstatus") == "F", gross).otherwise(F.lit(0)).alias("paid"))
    return rows.join(customers.select("c_custkey", F.col("c_name").alias("customer")), "c_custkey")


INVOICES_SQL = """invoices AS (SELECT 'INV-' || o_orderkey AS ref, c_name AS customer, o_orderdate::DATE AS issue_date, o_orderstatus AS status,
  round(o_totalprice * 100)::BIGINT AS gross, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 100)::BIGINT ELSE 0 END AS paid
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

#: Ledger account by return flag and line status.
ACCOUNTS = {"AF": "101", "AO": "411", "NF": "4331", "NO": "531", "RF": "601", "RO": "701"}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat("l_returnflag", "l_linestatus")
    code = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in ACCOUNTS.items()], F.lit("999"))
    amount, debit = cents(F.col("l_extendedprice")), F.col("l_linenumber") % 2 == 1
    return lines.select(F.col("l_orderkey").alias("entry_id"), code.alias("account_code"), F.when(debit, amount).otherwise(F.lit(0)).alias("debit"), F.when(~debit, amount).otherwise(F.lit(0)).alias("credit"))


LEDGER_SQL = """ledger AS (SELECT l_orderkey AS entry_id, CASE l_returnflag || l_linestatus WHEN 'AF' THEN '101' WHEN 'AO' THEN '411' WHEN 'NF' THEN '4331'
  WHEN 'NO' THEN '531' WHEN 'RF' THEN '601' WHEN 'RO' THEN '701' ELSE '999' END AS account_code,
  CASE WHEN l_linenumber % 2 = 1 THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END AS debit,
  CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE round(l_extendedprice * 100)::BIGINT END AS credit FROM lineitem)"""
