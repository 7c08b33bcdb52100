"""Retrieval queries. The query set is every embedding whose id is divisible by 20, with the two longest words of its document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.functions import measures, texts
from sheafmill.operators import ordering
from sheafmill.operators import retrieval as ops
from sheafmill.operators import stores
from sheafmill.plans import adapters as A
from sheafmill.sources import shared


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, docs = A.table(spark, sf_dir, "embeddings"), A.table(spark, sf_dir, "documents")
    q = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = q.join(docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), "query_id").withColumn("words", F.array_distinct(texts.lexemes(F.col("text"))))
    longest = F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return found.select("query_id", "embedding", F.transform(F.slice(longest, 1, 2), lambda x: x["w"]).alias("terms"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written query set, for searches by terms: where it is computed inside of other plans, conditions on its terms are tried on the texts of all documents, and its terms made several times."""
    return shared.written(query_set(spark, sf_dir), "queries")


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms: the words of part names."""
    return A.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct()


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def hybrid_rrf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ops.hybrid(asked(spark, sf_dir), A.chunks(spark, sf_dir), k=8, glossary=glossary(spark, sf_dir), contents=A.contents(spark, sf_dir))
    return top.select("query_id", "id", "rank", F.round("score", 9).alias("score"), "dense_rank", "lexical_rank", "collection", texts.excerpt(F.col("content"), 120).alias("excerpt"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector, all rows."""
    rows = rows_of(spark, sf_dir)
    return ops.dense_one(rows, list(rows.where("id = 0").first()["embedding"]), 32)


def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dense(query_set(spark, sf_dir), rows_of(spark, sf_dir), 10)


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lexical(asked(spark, sf_dir), A.contents(spark, sf_dir), 10)


def rrf_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, live, told = asked(spark, sf_dir), *(x(spark, sf_dir).where("review <> 'rejected'") for x in (A.chunks, A.contents))
    return ops.fused_join(ops.dense(q, live, 40), ops.lexical(q, told, 40)).withColumn("score", F.round("score", 9))


def retrieval_eval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall and reciprocal rank of the dense, lexical and fused lists of rows that aren't rejected; the fused one is fused from lists of four times its length.
    Gold are the rows of the query's label, itself left out."""
    q, live, told = asked(spark, sf_dir), *(x(spark, sf_dir).where("review <> 'rejected'") for x in (A.chunks, A.contents))
    labels = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    labelled = q.select("query_id").join(labels, F.col("query_id") == F.col("id")).select("query_id", "label")
    pool = ops.pool_size(10, 40)
    rank = lambda hits, order: shared.written(ops.ranked(hits.where("id <> query_id").drop("rank"), order, pool), "eval-hits")
    lists = {"dense": rank(ops.dense(q, live, pool + 1), ["distance", "id"]), "lexical": rank(ops.lexical(q, told, pool + 1), [F.desc("density"), "id"])}
    lists["hybrid"] = ops.fused(lists["dense"], lists["lexical"], 10)
    rows = [ops.evaluated_by_label(hits.where("rank <= 10"), labelled, labels).agg(F.lit(name).alias("retriever"), F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in ("recall_5", "recall_10", "mrr")]) for name, hits in lists.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.percentiles(A.table(spark, sf_dir, "events"), "event_type", "value", (50, 95, 99))


def dense_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.index_search(query_set(spark, sf_dir), rows_of(spark, sf_dir), 10)


def halves(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows as two batches."""
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    return {"first": rows.where(half == 0), "second": rows.where(half == 1)}


def stored_vectors(spark: SparkSession, rows: DataFrame) -> stores.VectorIndex:
    """A stored index, built of one batch, to which another is added, opened anew."""
    path, batches = shared.fresh_path(spark, "vector-index"), halves(rows.select("id", "embedding"))
    stores.VectorIndex.build(batches["first"], path, "first").add(batches["second"], "second")
    return stores.VectorIndex(spark, path)


def stored_postings(spark: SparkSession, rows: DataFrame) -> stores.Postings:
    postings = stores.Postings(spark, shared.fresh_path(spark, "postings"))
    for name, batch in halves(rows.select("id", "content")).items():
        postings.add(batch, name)
    return postings


def dense_stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir)
    return stored_vectors(spark, rows).search(query_set(spark, sf_dir), rows, 10)


def lexical_stored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.contents(spark, sf_dir)
    return ops.lexical(asked(spark, sf_dir), rows, 10, postings=stored_postings(spark, rows))


def term_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts have each of the queries' terms, by the stored counts of two batches."""
    terms = texts.once_exploded(asked(spark, sf_dir), "pos", "term", F.col("terms")).select("term").distinct()
    return stored_postings(spark, A.contents(spark, sf_dir)).document_counts(terms)


def hybrid_stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`hybrid_rrf_search` over stored indexes."""
    q, rows, told = asked(spark, sf_dir), A.chunks(spark, sf_dir), A.contents(spark, sf_dir)
    top = ops.hybrid(q, rows, k=8, glossary=glossary(spark, sf_dir), index=stored_vectors(spark, rows), postings=stored_postings(spark, told), contents=told)
    return top.select("query_id", "id", "rank", F.round("score", 9).alias("score"), "dense_rank", "lexical_rank", "collection", texts.excerpt(F.col("content"), 120).alias("excerpt"))


def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding a vector as text and parsing it back loses nothing."""
    rows = rows_of(spark, sf_dir)
    back = measures.vector_parsed(measures.vector_literal(F.col("embedding")))
    total = F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("id", (back == F.col("embedding")).alias("same"), F.size(back).cast("long").alias("dims"), F.round(total, 4).alias("total"))


QUERIES = {f.__name__: f for f in (hybrid_rrf_search, dense_topk, dense_topk_batch, lexical_topk, rrf_full_outer, retrieval_eval_matrix, latency_percentile, dense_index_search, dense_stored_search, lexical_stored_topk, term_documents, hybrid_stored_search, vector_literals)}

SET_SQL = A.CHUNKS_SQL + r""", q AS (SELECT vec_id AS query_id, e.embedding, list_distinct(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS ws
  FROM embeddings e JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0),
qt AS (SELECT query_id, t AS term FROM (SELECT query_id, unnest(ws) AS t FROM q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(t) DESC, t) <= 2),
qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id)"""


def dense_sql(name: str, rows: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
  SELECT q.query_id, r.id, round(1 - list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) *
  sqrt(list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))), 6) + 0.0 AS distance FROM q, {rows} r WHERE r.embedding IS NOT NULL)) WHERE rank <= {k})"""


def lexical_sql(name: str, rows: str, k: int, terms: str = "qt") -> str:
    """Rows with all terms, by cover density: a cover ends at an entry and begins at the earliest of the terms' last entries up to there."""
    return f"""{name}_t AS (SELECT id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (SELECT id, regexp_extract_all(lower(content), '[^\\x20\\x09-\\x0D]+') AS ws FROM {rows})),
{name}_n AS (SELECT query_id, count(*) AS n FROM {terms} GROUP BY query_id),
{name}_e AS (SELECT query_id, id, term, pos, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS i FROM {name}_t JOIN {terms} USING (term)
  WHERE (query_id, id) IN (SELECT (query_id, id) FROM {name}_t JOIN {terms} USING (term) JOIN {name}_n USING (query_id) GROUP BY query_id, id, n HAVING count(DISTINCT term) = n)),
{name}_l AS (SELECT a.query_id, a.id, a.i, a.pos, b.term, max(b.i) AS last FROM {name}_e a JOIN {name}_e b ON a.query_id = b.query_id AND a.id = b.id AND b.i <= a.i GROUP BY ALL),
{name}_b AS (SELECT l.query_id, l.id, i, pos, min(last) AS low FROM {name}_l l JOIN {name}_n USING (query_id) GROUP BY l.query_id, l.id, i, pos, n HAVING count(*) = n),
{name}_c AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY query_id, id ORDER BY i), 0) AS before FROM {name}_b),
{name}_d AS (SELECT c.query_id, c.id, round(sum(CASE WHEN c.low > before THEN 0.1::DOUBLE / (1 + (c.pos - e.pos) - (c.i - c.low)) ELSE 0 END), 6) AS density
  FROM {name}_c c JOIN {name}_e e ON e.query_id = c.query_id AND e.id = c.id AND e.i = c.low GROUP BY c.query_id, c.id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY density DESC, id) AS rank FROM {name}_d) WHERE rank <= {k})"""


EXPANDED = """qx AS (SELECT * FROM qt UNION SELECT query_id, g.term FROM (SELECT query_id, string_agg(term, ' ' ORDER BY length(term) DESC, term) AS said FROM qt GROUP BY query_id),
  (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part) g WHERE contains(said, g.term))"""
LIVE = "live AS (SELECT * FROM chunks WHERE review <> 'rejected')"
SCORE = "coalesce(1.0::DOUBLE / (60 + a.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0::DOUBLE)"
ALL_ROWS = "rows_ AS (SELECT vec_id AS id, embedding FROM embeddings)"
GOLD = "gold AS (SELECT q.query_id, b.vec_id AS g FROM q JOIN embeddings a ON a.vec_id = q.query_id JOIN embeddings b ON b.label = a.label AND b.vec_id <> q.query_id)"
RERANK = "row_number() OVER (PARTITION BY query_id ORDER BY {}) AS r"


def metrics_sql(name: str) -> str:
    return f"""SELECT '{name}' AS retriever, count(*) AS n, round(avg(r5), 4) AS recall_5, round(avg(r10), 4) AS recall_10, round(avg(mrr), 4) AS mrr FROM (
  SELECT g.query_id, sum(CASE WHEN h.r <= 5 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS r5, sum(CASE WHEN h.r <= 10 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS r10, coalesce(1.0::DOUBLE / min(h.r), 0.0::DOUBLE) AS mrr
  FROM gold g LEFT JOIN {name}_list h ON h.query_id = g.query_id AND h.id = g.g AND h.r <= 10 GROUP BY g.query_id)"""


ORACLE = {
    "hybrid_rrf_search": f"""WITH {SET_SQL}, {EXPANDED}, {LIVE}, {dense_sql('a', 'live', 100)}, {lexical_sql('b', 'live', 100, 'qx')},
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS dense_rank, b.rank AS lexical_rank, {SCORE} AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
SELECT query_id, t.id, rank, round(score, 9) AS score, dense_rank, lexical_rank, collection, substr(content, 1, 120) AS excerpt FROM t JOIN live USING (id) WHERE rank <= 8""",
    "dense_topk": f"WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id = 0), {ALL_ROWS}, {dense_sql('a', 'rows_', 32)} SELECT id, distance FROM a",
    "dense_topk_batch": f"WITH {SET_SQL}, {ALL_ROWS}, {dense_sql('a', 'rows_', 10)} SELECT * FROM a",
    "lexical_stored_topk": f"WITH {SET_SQL}, {lexical_sql('b', 'chunks', 10)} SELECT * FROM b",
    "term_documents": f"WITH {SET_SQL}, t AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(content), '[^\\x20\\x09-\\x0D]+'))) AS term FROM chunks) SELECT term, count(*) AS n_docs FROM t WHERE term IN (SELECT term FROM qt) GROUP BY term",
    "lexical_topk": f"WITH {SET_SQL}, {lexical_sql('b', 'chunks', 10)} SELECT * FROM b",
    "rrf_full_outer": f"""WITH {SET_SQL}, {LIVE}, {dense_sql('a', 'live', 40)}, {lexical_sql('b', 'live', 40)}
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS dense_rank, b.rank AS lexical_rank, round({SCORE}, 9) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id""",
    "retrieval_eval_matrix": f"""WITH {SET_SQL}, {LIVE}, {dense_sql('da', 'live', 41)}, {lexical_sql('lb', 'live', 41)}, {GOLD},
dense_list AS (SELECT * FROM (SELECT query_id, id, {RERANK.format('distance, id')} FROM da WHERE id <> query_id) WHERE r <= 40),
lexical_list AS (SELECT * FROM (SELECT query_id, id, {RERANK.format('density DESC, id')} FROM lb WHERE id <> query_id) WHERE r <= 40),
hybrid_list AS (SELECT query_id, id, {RERANK.format('score DESC, id')} FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id,
  coalesce(1.0::DOUBLE / (60 + a.r), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + b.r), 0.0::DOUBLE) AS score FROM dense_list a FULL JOIN lexical_list b ON a.query_id = b.query_id AND a.id = b.id))
{' UNION ALL '.join(metrics_sql(n) for n in ('dense', 'lexical', 'hybrid'))}""",
    "latency_percentile": "SELECT event_type, " + ", ".join(f"list_sort(list(value))[(least(count(*) - 1, floor(count(*) * {p} / 100.0)) + 1)::BIGINT] AS p{p}" for p in (50, 95, 99)) + " FROM events GROUP BY event_type",
    "vector_literals": "SELECT vec_id AS id, true AS same, len(embedding)::BIGINT AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
}
