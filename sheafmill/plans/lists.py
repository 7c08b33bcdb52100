"""Queries of filtered lists, lookups, probes and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafmill.operators import filters as ops
from sheafmill.operators import model
from sheafmill.plans import adapters as A
from sheafmill.sources import tables

T = A.table


def contract_probe(spark, sf_dir):
    tables.registered(spark, {"contract_customer": T(spark, sf_dir, "customer"), "contract_invoice": A.invoices(spark, sf_dir), "contract_ledger": A.ledger(spark, sf_dir)})
    return tables.probe(spark, ["contract_customer", "contract_invoice", "contract_ledger", "contract_payroll"])


def chart_search(spark, sf_dir):
    rows = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    return ops.listed(ops.matching(rows, "RED", "p_name", "p_brand"), ["p_name", "id"], 500)


def filtered_chunks(spark, sf_dir):
    rows = ops.among(A.chunks(spark, sf_dir), F.col("collection"), ["src0", "src7"])
    rows = ops.flagged(ops.among(rows, F.col("lang"), []), F.col("reported"), False)
    return rows.where("token_count > 20").select("id", "collection", F.col("embedding").isNotNull().alias("has_embedding"))


def ordered_lookup(spark, sf_dir):
    """Names of an order's parts in line order, as one text."""
    lists = T(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    parts = T(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"))
    return ops.looked_up(lists, parts).select("query_id", F.array_join("contents", "|").alias("names"))


def row_problems(spark, sf_dir):
    rows = A.chunks(spark, sf_dir)
    checks = {"language": ops.is_choice(F.col("lang"), "lang"), "license": ops.is_choice(F.col("license"), "license"), "size": F.col("token_count").between(1, 2000), "slug": ops.has_format(F.col("collection"), "slug")}
    return rows.select("id", F.array_join(ops.problems(**checks), ",").alias("problems")).where("problems <> ''")


def audit_events(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return model.audit(rows, "message.created", F.lit("2024-01-30"), "conv_id", "turn", "role").select("id", "event_type", "payload")


def storage_keys(spark, sf_dir):
    rows = T(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("h"), "url")
    return rows.select("page_id", model.storage_key(F.lit("pages"), F.col("h"), F.col("url")).alias("key"))


def kind_filtered(spark, sf_dir):
    """Events whose JSON names one of the wanted kinds; of an empty list, all would pass."""
    rows = T(spark, sf_dir, "events")
    kind = F.get_json_object("props", "$.k")
    return ops.among(ops.among(rows, kind, ["1", "7", "42", "87"]), F.col("event_type"), []).select("event_id", kind.alias("kind"))


def search_requests(spark, sf_dir):
    """Turns as search requests: what is wrong with each, whose number of results is now and then out of bounds or absent."""
    rows = T(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("query"))
    k = F.when(F.col("turn") % 4 != 3, (F.col("conv_id") * 7 + F.col("turn") * 13) % 60 - 4)
    return rows.select("conv_id", "turn", F.array_join(ops.request_problems(F.col("query"), k), ",").alias("problems"))


def safe_keys(spark, sf_dir):
    """Addresses as keys of stored objects: those that stay in their folder."""
    rows = T(spark, sf_dir, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "../").when(F.col("page_id") % 3 == 1, "/").otherwise(""), F.col("url")).alias("key"))
    return rows.where(~model.path_escapes(F.col("key")))


QUERIES = {f.__name__: f for f in (kind_filtered, search_requests, safe_keys, contract_probe, chart_search, filtered_chunks, ordered_lookup, row_problems, audit_events, storage_keys)}

ORACLE = {
    "kind_filtered": "SELECT event_id, props->>'$.k' AS kind FROM events WHERE props->>'$.k' IN ('1', '7', '42', '87')",
    "search_requests": """WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '' END AS q, CASE WHEN turn % 4 <> 3 THEN (conv_id * 7 + turn * 13) % 60 - 4 END AS k FROM conversations)
SELECT conv_id, turn, concat_ws(',', CASE WHEN length(q) < 1 THEN 'query' END, CASE WHEN k IS NOT NULL AND k NOT BETWEEN 1 AND 50 THEN 'k' END) AS problems FROM r""",
    "safe_keys": "SELECT page_id, url AS key FROM pages WHERE page_id % 3 = 2 AND NOT starts_with(url, '/') AND NOT list_contains(string_split(url, '/'), '..')",
    "contract_probe": "SELECT 'contract_customer' AS view, count(*) AS rows FROM customer UNION ALL SELECT 'contract_invoice', count(*) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'contract_ledger', count(*) FROM lineitem UNION ALL SELECT 'contract_payroll', NULL",
    "chart_search": "SELECT p_partkey AS id, p_name, p_brand FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%RED%' ORDER BY p_name, p_partkey LIMIT 50",
    "filtered_chunks": f"WITH {A.CHUNKS_SQL} SELECT id, collection, embedding IS NOT NULL AS has_embedding FROM chunks WHERE collection IN ('src0', 'src7') AND NOT reported AND token_count > 20",
    "ordered_lookup": "SELECT l_orderkey AS query_id, string_agg(coalesce(p_name, ''), '|' ORDER BY l_linenumber, l_partkey) AS names FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY l_orderkey",
    "row_problems": f"""WITH {A.CHUNKS_SQL}, p AS (SELECT id, concat_ws(',', CASE WHEN lang NOT IN ('lo', 'en', 'mixed', 'th') THEN 'language' END, CASE WHEN license NOT IN ('public', 'internal', 'client-confidential') THEN 'license' END,
  CASE WHEN token_count NOT BETWEEN 1 AND 2000 THEN 'size' END, CASE WHEN NOT regexp_matches(collection, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'slug' END) AS problems FROM chunks) SELECT * FROM p WHERE problems <> ''""",
    "audit_events": """WITH b AS (SELECT '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}' AS payload FROM conversations) SELECT sha256('message.created|' || payload) AS id, 'message.created' AS event_type, payload FROM b""",
    "storage_keys": "SELECT page_id, 'pages/' || substr(sha256(html), 1, 2) || '/' || sha256(html) || '/' || regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS key FROM pages",
}
