"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafmill.functions import texts
from sheafmill.operators import assist
from sheafmill.operators import dashboard as ops
from sheafmill.operators import ordering
from sheafmill.plans import adapters as A

C, T = A.chunks, A.table
NOW = "2024-01-30 12:00:00"


def list_collections(spark, sf_dir):
    """Distinct names of canonical, document and page-host collections, in order."""
    fixed = assist.canonical(spark).where("kind = 'collection'").select(F.col("name").alias("collection"))
    docs = T(spark, sf_dir, "documents").select(F.col("source").alias("collection"))
    hosts = T(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("collection"))
    return fixed.union(docs).union(hosts).where("collection <> ''").distinct().orderBy("collection")


def merged_sources(spark, sf_dir):
    """Three kinds of sources one after the other with running ordinals in each collection."""
    docs = T(spark, sf_dir, "documents").select(F.lit("dataset").alias("origin"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("part"), F.col("doc_id").alias("o"))
    erp = A.invoices(spark, sf_dir).select(F.lit("erp").alias("origin"), F.concat(F.lit("erp:"), "ref").alias("id"), "status", F.substring("ref", 5, 20).cast("long"))
    web = T(spark, sf_dir, "pages").select(F.lit("web").alias("origin"), F.concat(F.lit("web:"), F.col("page_id").cast("string")).alias("id"), F.lit("web"), "page_id")
    return ordering.numbered(docs.union(erp).union(web), ["origin", "part"], ["o"]).select("origin", "id", "part", "n")


def gaps_latest_question(spark, sf_dir):
    return ops.gaps(T(spark, sf_dir, "conversations"))


def answers_with_question(spark, sf_dir):
    """Every answer with the latest question before it."""
    m = T(spark, sf_dir, "conversations")
    return ops.latest_before(m, F.col("role") == "assistant", F.col("role") == "user").select("conv_id", "turn", "question")


def reported_chunks(spark, sf_dir):
    return C(spark, sf_dir).where("reported").select("id", "collection", "review", texts.excerpt(F.col("content"), 160).alias("excerpt"))


def conversation_titles(spark, sf_dir):
    m = T(spark, sf_dir, "conversations")
    from pyspark.sql import Window

    first = m.where("role = 'user'").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("k = 1")
    return first.select("conv_id", texts.title_of(F.col("text")).alias("title"))


def documents_with_counts(spark, sf_dir):
    """Customers with counts of their orders, as parents with counts of children."""
    orders = T(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return ops.with_counts(T(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey", F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


def conversation_transcripts(spark, sf_dir):
    """Threads with message counts, user turns and all texts in order."""
    m = T(spark, sf_dir, "conversations")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return m.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("user_turns"), joined.alias("transcript"))


QUERIES = {
    "overview_counts": lambda s, d: ops.overview(C(s, d)),
    "by_collection": lambda s, d: ops.by_collection(C(s, d)),
    "ingest_stats": lambda s, d: C(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count")).cast("long").alias("mean")),
    "qa_stats_multikey": lambda s, d: ops.grouped_counts(C(s, d), "review", "reported", "license"),
    "kind_counts_json": lambda s, d: T(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")),
    "distinct_askers": lambda s, d: T(s, d, "conversations").groupBy("role").agg(F.countDistinct("conv_id").alias("threads"), F.count("*").alias("messages")),
    "last_n_messages": lambda s, d: ops.last_messages(T(s, d, "conversations")),
    "activity_latest": lambda s, d: T(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(8).select("event_id", "event_type", "user_id"),
    "recency_buckets": lambda s, d: T(s, d, "events").groupBy(ops.recency(F.col("ts"), F.to_timestamp_ntz(F.lit(NOW))).alias("bucket")).agg(F.count("*").alias("n")),
    **{f.__name__: f for f in (list_collections, merged_sources, gaps_latest_question, answers_with_question, reported_chunks, conversation_titles, documents_with_counts, conversation_transcripts)},
}

ORACLE = {
    "overview_counts": f"""WITH {A.CHUNKS_SQL} SELECT count(*) AS chunks, count(DISTINCT collection) AS collections, count(*) FILTER (review = 'pending') AS pending, count(*) FILTER (review = 'accepted') AS accepted,
  count(*) FILTER (review = 'rejected') AS rejected, count(*) FILTER (review = 'edited') AS edited, count(embedding) AS embedded, round(avg(token_count))::BIGINT AS mean_tokens, min(token_count) AS least_tokens, max(token_count) AS most_tokens, sum(token_count)::BIGINT AS tokens FROM chunks""",
    "by_collection": f"WITH {A.CHUNKS_SQL} SELECT collection, count(*) AS chunks, count(*) FILTER (review = 'accepted') AS accepted, count(embedding) AS embedded FROM chunks GROUP BY collection",
    "ingest_stats": f"WITH {A.CHUNKS_SQL} SELECT lang, count(*) AS n, min(token_count) AS least, max(token_count) AS most, round(avg(token_count))::BIGINT AS mean FROM chunks GROUP BY lang",
    "qa_stats_multikey": f"WITH {A.CHUNKS_SQL} SELECT review, reported, license, count(*) AS n FROM chunks GROUP BY ALL",
    "kind_counts_json": "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "distinct_askers": "SELECT role, count(DISTINCT conv_id) AS threads, count(*) AS messages FROM conversations GROUP BY role",
    "last_n_messages": """WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN substr(text, 1, 300) ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM b WHERE back BETWEEN 2 AND 8""",
    "activity_latest": "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 8",
    "recency_buckets": f"""SELECT CASE WHEN ts >= TIMESTAMP '2024-01-30' THEN 'today' WHEN ts >= TIMESTAMP '2024-01-29' THEN 'yesterday' WHEN ts >= TIMESTAMP '2024-01-23' THEN 'previous 7 days' ELSE 'older' END AS bucket, count(*) AS n FROM events GROUP BY 1""",
    "list_collections": "SELECT DISTINCT c AS collection FROM (SELECT unnest(['lao-accounting-law', 'coa', 'tax', 'sop', 'lao-style']) AS c UNION ALL SELECT source FROM documents UNION ALL SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) FROM pages) WHERE c <> ''",
    "merged_sources": f"""WITH {A.INVOICES_SQL}, r AS (SELECT 'dataset' AS origin, 'doc:' || doc_id AS id, source AS part, doc_id AS o FROM documents UNION ALL SELECT 'erp', 'erp:' || ref, status, substr(ref, 5)::BIGINT FROM invoices
  UNION ALL SELECT 'web', 'web:' || page_id, 'web', page_id FROM pages) SELECT origin, id, part, row_number() OVER (PARTITION BY origin, part ORDER BY o) AS n FROM r""",
    "gaps_latest_question": r"""WITH a AS (SELECT conv_id, turn, text, (SELECT u.text FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn < c.turn ORDER BY u.turn DESC LIMIT 1) AS question
  FROM conversations c WHERE role = 'assistant' AND NOT regexp_matches(text, '\[[0-9]+\]')), n AS (SELECT * FROM a ORDER BY turn DESC, conv_id DESC LIMIT 10)
SELECT conv_id, turn, substr(question, 1, 160) AS question, substr(text, 1, 240) AS answer FROM n WHERE question IS NOT NULL""",
    "answers_with_question": "SELECT conv_id, turn, (SELECT u.text FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn < c.turn ORDER BY u.turn DESC LIMIT 1) AS question FROM conversations c WHERE role = 'assistant'",
    "reported_chunks": f"WITH {A.CHUNKS_SQL} SELECT id, collection, review, substr(content, 1, 160) AS excerpt FROM chunks WHERE reported",
    "conversation_titles": """WITH f AS (SELECT conv_id, trim(split_part(trim(text), chr(10), 1)) AS t FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)
SELECT conv_id, CASE WHEN t = '' THEN 'New conversation' WHEN length(t) > 48 THEN substr(t, 1, 48) || '…' ELSE t END AS title FROM f""",
    "documents_with_counts": "SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders, count(*) FILTER (o_orderstatus = 'P') AS pending FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "conversation_transcripts": "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS user_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id",
}
