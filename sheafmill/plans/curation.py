"""Curation, lifecycle and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafmill.functions import measures, texts
from sheafmill.operators import curation as ops
from sheafmill.operators import assist, export, filters, lifecycle
from sheafmill.plans import adapters as A
from sheafmill.plans.retrieval import lexical_sql
from sheafmill.sources import shared

C, T = A.chunks, A.table
FORMS = ["token =", "License", "***", "the and", "%%%"]


def glossary(spark, sf_dir):
    """Terms: the words of part names."""
    return T(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()


def qa(spark, sf_dir):
    """A question an order, citing the parts of its lines."""
    lines = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qa_id"), "l_linenumber", "l_partkey")
    return lines.groupBy("qa_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("citations"))


def cited_chunks(spark, sf_dir):
    """A chunk a part: its review by size, its document by brand."""
    size = F.col("p_size")
    return T(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size < 5, "rejected").when(size < 25, "pending").otherwise("accepted").alias("review"), F.col("p_brand").alias("document"), F.col("p_type").alias("kind"))


QA_SQL = """qa AS (SELECT l_orderkey AS qa_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS citations FROM lineitem GROUP BY l_orderkey),
parts AS (SELECT p_partkey AS id, CASE WHEN p_size < 5 THEN 'rejected' WHEN p_size < 25 THEN 'pending' ELSE 'accepted' END AS review, p_brand AS document, p_type AS kind FROM part)"""


def term_mining(spark, sf_dir):
    known = T(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("term"))
    return ops.mined_terms(A.contents(spark, sf_dir).where("review <> 'rejected'"), known)


def glossary_expand(spark, sf_dir):
    return ops.substrings_in(T(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("text")), T(spark, sf_dir, "nation").select(F.lower("n_name").alias("term")).union(T(spark, sf_dir, "documents").select("lang")).union(T(spark, sf_dir, "documents").select("source")).distinct())


def glossary_questions(spark, sf_dir):
    """Glossary terms in whole question texts."""
    return ops.substrings_in(T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), glossary(spark, sf_dir))


def split_assign(spark, sf_dir):
    return ops.with_splits(qa(spark, sf_dir), cited_chunks(spark, sf_dir))


def account_infer(spark, sf_dir):
    found = T(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("code"))
    return found.select("p_partkey", "code", texts.account_attributes(F.col("code")).alias("of")).select("p_partkey", "code", "of.*")


def account_infer_mismatch(spark, sf_dir):
    """Ledger accounts whose inferred side disagrees with the sign of their balance."""
    from sheafmill.operators import ledger

    rows = ledger.account_balance(A.ledger(spark, sf_dir)).withColumn("of", texts.account_attributes(F.col("account_code")))
    return rows.withColumn("side", F.when(F.col("balance") >= 0, "debit").otherwise("credit")).where("side <> of.normal_balance").select("account_code", "side", F.col("of.normal_balance").alias("inferred"))


def upsert_ignore(spark, sf_dir):
    """Customers by name take in suppliers' numbers as names, without those there, the first of each."""
    base = T(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), "c_mktsegment").distinct().withColumn("v", F.lit("base"))
    rows = T(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("k"), F.lit("MACHINERY").alias("c_mktsegment"), F.col("o_orderpriority").alias("v"))
    return lifecycle.insert_or_ignore(base, rows, ["k", "c_mktsegment"], "v")


def patch_update(spark, sf_dir):
    base = T(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("verified"))
    patch = T(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(9).alias("quality"))
    return lifecycle.patched(base, patch, "doc_id")


def verify_rows(spark, sf_dir):
    base = T(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verified"))
    return lifecycle.verified(base, T(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "reviewer", F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00")))


def review_transitions(spark, sf_dir):
    actions = T(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "accept").when(F.col("lang") == "fr", "reject").when(F.col("lang") == "es", "edit").alias("action"), texts.upper_by_character(F.col("text")).alias("content")).where("action IS NOT NULL")
    out, _ = lifecycle.reviewed(C(spark, sf_dir), actions)
    return out.select("id", "review", F.sha2("content", 256).alias("sha256"), F.col("embedding").isNotNull().alias("has_embedding"), "token_count", "lang")


def bulk_accept(spark, sf_dir):
    return lifecycle.bulk_accepted(C(spark, sf_dir), F.col("collection") == "src0", 100).select("id", "review")


def cascade_delete(spark, sf_dir):
    """Customers without orders in process, after their loss; references of orders to them become null."""
    orders = T(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_custkey").alias("ref"))
    customers = T(spark, sf_dir, "customer").select("c_custkey", "c_name")
    gone = customers.join(T(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    parents, children, refs = lifecycle.cascade_deleted(customers, orders, gone, "c_custkey", orders.select("o_orderkey", "ref"), "ref")
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(parents, "parents").union(count(children, "children")).union(refs.agg(F.lit("references"), F.count("ref")))


def report_merge(spark, sf_dir):
    return lifecycle.json_merged(T(spark, sf_dir, "events").select("event_id", "event_type", "props"), T(spark, sf_dir, "events").where("event_type = 'error'").select("event_id"), "event_id", "props", "reported", True)


def replace_children(spark, sf_dir):
    rows = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("v"))
    fresh = T(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("new").alias("v"))
    return lifecycle.children_replaced(rows, fresh, "l_orderkey").groupBy("v").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


def retention(spark, sf_dir):
    return lifecycle.newest_kept(T(spark, sf_dir, "events"), 3, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("event_id", "user_id")


def export_chunks(spark, sf_dir):
    return export.exportable(C(spark, sf_dir), shareable=True).select("id", "collection", "license", "review", F.sha2("content", 256).alias("sha256"))


def export_manifest(spark, sf_dir):
    rows = export.exportable(C(spark, sf_dir), shareable=True).withColumn("split", measures.split_name(measures.fnv1a_unit(F.col("collection"))))
    return export.manifest(export.lines(rows, ["id", "collection"], F.col("split")))


def export_files(spark, sf_dir):
    """Whole chunks as files of a version, by parts of 256 KB: what was written, as it is read back."""
    rows = export.exportable(C(spark, sf_dir), shareable=True).withColumn("split", measures.split_name(measures.fnv1a_unit(F.col("collection"))))
    return export.write(export.lines(rows, ["id", "content"], F.col("split")), shared.fresh_path(spark, "export"), "1.0.0", 1 << 18).select("file", "part", "records", "bytes", "sha256")


def eval_set(spark, sf_dir):
    accounts = ops.first_names(T(spark, sf_dir, "part").select((F.col("p_partkey") % 997 + 100).cast("string").alias("code"), "p_name", "p_partkey"), "code", "p_name", "p_partkey").withColumn("ids", F.col("ids"))
    return ops.eval_questions(accounts).select("code", "question", F.size("gold").cast("long").alias("n_gold"))


AT = "2024-01-30"


def kinds(spark, sf_dir):
    """Parts as chunks of documents (a brand's parts of a kind, of which there are 500), and questions of orders in process that cite them."""
    parts = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("k"), (F.col("p_partkey") % 500).cast("string")).alias("kind"), F.concat_ws("/", "p_brand", (F.col("p_partkey") % 500).cast("string")).alias("document"))
    asked = qa(spark, sf_dir).join(T(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("qa_id")), "qa_id", "left_semi")
    return parts.select("document", "kind").distinct(), parts.select("id", "document"), asked


def kind_citations(spark, sf_dir):
    return lifecycle.citations_of_kinds(*kinds(spark, sf_dir))


def kinds_deleted(spark, sf_dir):
    """Every fifth kind is deleted, if no question cites it."""
    documents, chunks, asked = kinds(spark, sf_dir)
    gone = documents.where("CAST(substr(kind, 2) AS INT) % 5 = 0").select("kind")
    docs_left, chunks_left, report, events = lifecycle.kinds_deleted(documents, chunks, asked, gone, F.lit(AT))
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(docs_left, "documents").union(count(chunks_left, "chunks")).union(count(report.where("blocked"), "blocked")).union(count(events, "events"))


def document_delete(spark, sf_dir):
    """Sources as documents: two go, with their chunks and jobs, and an event each tells of it."""
    chunks = T(spark, sf_dir, "documents").select(F.col("source").alias("document"), "doc_id")
    documents = chunks.select("document").distinct()
    gone = spark.createDataFrame([("src0",), ("src3",), ("none",)], "document string")
    parts = lifecycle.documents_deleted(documents, chunks, documents.withColumn("job_type", F.lit("embed")), gone, F.lit(AT))
    told = parts[3].select(F.get_json_object("payload", "$.document").alias("what"), F.get_json_object("payload", "$.deleted_chunks").cast("long").alias("n"))
    left = [p.agg(F.lit(what).alias("what"), F.count("*").alias("n")) for p, what in zip(parts, ("documents", "chunks", "jobs"), strict=False)]
    return left[0].union(left[1]).union(left[2]).union(told)


def purge_but_one(spark, sf_dir):
    """Only the newest document of the first source stays, with its label."""
    docs = T(spark, sf_dir, "documents")
    kept = docs.where("source = 'src0'").agg(F.max("doc_id").alias("doc_id"))
    return lifecycle.purged_but(docs.select("doc_id", "source", "lang"), kept, "doc_id")


def account_names(spark, sf_dir):
    parts = T(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 997 + 100).cast("string").alias("code"), "p_name", "p_type")
    content = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("code", F.lit("  "), "p_name", F.lit(" — "), "p_type"))
    return parts.select("p_partkey", ops.account_name(content, F.col("code")).alias("name"))


def verified_counts(spark, sf_dir):
    return T(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("verified"))


def verified_first(spark, sf_dir):
    rows = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_size") > 45).alias("verified"))
    return filters.flag_first(rows, "verified", "p_name", "id")


def tenant_counts(spark, sf_dir):
    """Documents as rows of tenants (language and source): one tenant's, by decile of length."""
    rows = T(spark, sf_dir, "documents").withColumnsRenamed({"lang": "hf_id", "source": "company_id"})
    return filters.of_tenant(rows, "en", "src0").groupBy((F.col("n_chars") % 10).alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def vectors_set(spark, sf_dir):
    """Every second pending chunk gets a vector; statuses by collection and fifty ids."""
    rows = C(spark, sf_dir).withColumn("collection", F.concat("collection", F.lit("/"), F.floor(F.col("id") / 50).cast("string")))
    vectors = rows.where("embedding IS NULL AND id % 2 = 0").select("id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    return lifecycle.with_vectors(rows, vectors)[1]


def export_card(spark, sf_dir):
    """A data card's lines for the shared export."""
    rows = export.exportable(C(spark, sf_dir), shareable=True).withColumn("split", measures.split_name(measures.fnv1a_unit(F.col("collection"))))
    card = export.data_card(export.manifest(export.lines(rows, ["id", "collection"], F.col("split"))), C(spark, sf_dir), "1.0.0")
    return card.select("place", F.regexp_replace("line", "[0-9a-f]{64}", "hash").alias("line"))


def text_checks(spark, sf_dir):
    """Texts with words of the script in them, against a dictionary of one of those words."""
    word, other = "ບັນຊີ", "ບັນຊຶ"
    rows = C(spark, sf_dir).select("id", F.concat("content", F.lit(f" {word}  "), F.when(F.col("id") % 3 == 0, other).otherwise("")).alias("content"))
    known = spark.createDataFrame([(word,)], "word string")
    return assist.checked_texts(rows, known, [other, "token ="]).select("id", "words", "unknown", F.array_join("forbidden", ",").alias("forbidden"))


def cited_questions(spark, sf_dir):
    """Benchmark items as questions: every third names its citation, the others take the top hit for their two longest words."""
    items = T(spark, sf_dir, "benchmark")
    longest = F.array_sort(F.transform(F.array_distinct(texts.lexemes(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    given = F.when(F.col("item_id") % 3 == 0, F.array("item_id")).otherwise(F.array().cast("array<bigint>"))
    asked = items.select(F.col("item_id").alias("qa_id"), given.alias("citations"), F.transform(F.slice(longest, 1, 2), lambda x: x["w"]).alias("terms"))
    return assist.cited(asked, C(spark, sf_dir)).select("qa_id", F.array_join(F.transform("citations", lambda c: c.cast("string")), ",").alias("citations"))


QUERIES = {
    "forbidden_terms": lambda s, d: ops.forbidden_in(C(s, d), FORMS),
    "cited_qa_overlap": lambda s, d: ops.citing(qa(s, d), cited_chunks(s, d).where("kind = 'ECONOMY'")),
    "export_qa_valid": lambda s, d: ops.all_citations_in(qa(s, d), cited_chunks(s, d).where("review <> 'rejected'")).select("qa_id", F.size("citations").cast("long").alias("n")),
    "citation_validation": lambda s, d: ops.citation_problems(qa(s, d), cited_chunks(s, d)),
    "doc_dedupe": lambda s, d: lifecycle.content_deduped(C(s, d)),
    "fully_embedded": lambda s, d: lifecycle.fully_embedded(C(s, d).withColumn("collection", F.concat("collection", F.lit("/"), F.floor(F.col("id") / 50).cast("string")))),
    "export_licenses": lambda s, d: export.licenses(C(s, d)),
    **{f.__name__: f for f in (term_mining, glossary_expand, glossary_questions, split_assign, account_infer, account_infer_mismatch, kind_citations, kinds_deleted, document_delete, purge_but_one, account_names, verified_counts, verified_first, tenant_counts, vectors_set, export_files, export_card, text_checks, cited_questions, upsert_ignore, patch_update, verify_rows, review_transitions, bulk_accept, cascade_delete, report_merge, replace_children, retention, export_chunks, export_manifest, eval_set)},
}

KINDS_SQL = """kc AS (SELECT p_partkey AS id, 'k' || p_partkey % 500 AS kind, p_brand || '/' || p_partkey % 500 AS document FROM part), kd AS (SELECT DISTINCT document, kind FROM kc),
cq AS (SELECT qa_id, unnest(list_distinct(citations)) AS id FROM qa WHERE qa_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')),
cd AS (SELECT DISTINCT kind, document, qa_id FROM cq JOIN kc USING (id)), ck AS (SELECT kind, count(*) AS cited_qa, count(DISTINCT qa_id) AS distinct_qa FROM cd GROUP BY kind),
report AS (SELECT k.kind, count(DISTINCT k.document) AS documents, count(*) AS chunks, coalesce(any_value(cited_qa), 0)::BIGINT AS cited_qa, coalesce(any_value(distinct_qa), 0)::BIGINT AS distinct_qa FROM kc k LEFT JOIN ck USING (kind) GROUP BY k.kind)"""

FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
UNIT = f"(({FNV}) % 100000) / 100000.0::DOUBLE"
BY_LEAD = "CASE substr(code, 1, 1) WHEN '2' THEN {0} WHEN '3' THEN {1} WHEN '4' THEN {2} WHEN '5' THEN {3} WHEN '6' THEN {3} ELSE {4} END"
ATTRIBUTES = ", ".join(f"{BY_LEAD.format(*[repr(x) for x in xs])} AS {name}" for name, xs in {
    "account_class": ("liability", "equity", "revenue", "expense", "asset"), "normal_balance": ("credit", "credit", "credit", "debit", "debit"), "statement": ("BS", "BS", "PL", "PL", "BS")}.items())

ORACLE = {
    "forbidden_terms": "SELECT doc_id AS id, form, ((length(text) - length(replace(text, form, ''))) // length(form))::BIGINT AS places FROM documents, (SELECT unnest(['token =', 'License', '***', 'the and', '%%%']) AS form) WHERE contains(text, form)",
    "cited_qa_overlap": f"WITH {QA_SQL}, x AS (SELECT qa_id, unnest(list_distinct(citations)) AS id FROM qa) SELECT qa_id, count(*) AS cited FROM x WHERE id IN (SELECT id FROM parts WHERE kind = 'ECONOMY') GROUP BY qa_id",
    "export_qa_valid": f"WITH {QA_SQL}, x AS (SELECT qa_id, unnest(citations) AS id FROM qa) SELECT qa_id, len(citations)::BIGINT AS n FROM qa WHERE qa_id NOT IN (SELECT qa_id FROM x LEFT JOIN parts USING (id) WHERE coalesce(review, 'rejected') = 'rejected')",
    "citation_validation": f"""WITH {QA_SQL}, x AS (SELECT qa_id, len(citations) AS n, unnest(list_distinct(citations)) AS id FROM qa), p AS (SELECT qa_id, n, count(review) AS known, count(*) FILTER (review = 'rejected') AS refused FROM x LEFT JOIN parts USING (id) GROUP BY qa_id, n)
SELECT qa_id, CASE WHEN n = 0 THEN 'empty' WHEN known < n THEN 'missing' ELSE 'rejected' END AS reason FROM p WHERE n = 0 OR known < n OR refused > 0""",
    "doc_dedupe": "SELECT source AS collection, sha256(text) AS sha256, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1, 2",
    "fully_embedded": f"WITH {A.CHUNKS_SQL} SELECT collection || '/' || (id // 50) AS collection FROM chunks GROUP BY 1 HAVING count(*) = count(embedding)",
    "kind_citations": f"WITH {QA_SQL}, {KINDS_SQL} SELECT * FROM report",
    "kinds_deleted": f"""WITH {QA_SQL}, {KINDS_SQL}, r AS (SELECT * FROM report WHERE substr(kind, 2)::INT % 5 = 0), g AS (SELECT kind FROM r WHERE cited_qa = 0)
SELECT 'documents' AS what, count(*) AS n FROM kd WHERE kind NOT IN (FROM g) UNION ALL SELECT 'chunks', count(*) FROM kc WHERE kind NOT IN (FROM g)
UNION ALL SELECT 'blocked', count(*) FROM r WHERE cited_qa > 0 UNION ALL SELECT 'events', count(*) FROM g""",
    "document_delete": """WITH d AS (SELECT source FROM documents WHERE source NOT IN ('src0', 'src3'))
SELECT 'documents' AS what, count(DISTINCT source) AS n FROM d UNION ALL SELECT 'chunks', count(*) FROM d UNION ALL SELECT 'jobs', count(DISTINCT source) FROM d
UNION ALL SELECT source, count(*) FROM documents WHERE source IN ('src0', 'src3') GROUP BY source""",
    "purge_but_one": "SELECT doc_id, source, lang FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents WHERE source = 'src0')",
    "account_names": "SELECT p_partkey, p_name AS name FROM part",
    "verified_counts": "SELECT p_type AS kind, count(*) AS n, count(*) FILTER (p_size > 25) AS verified FROM part GROUP BY p_type",
    "verified_first": "SELECT p_partkey AS id, p_name, p_size > 45 AS verified FROM part ORDER BY verified DESC, p_name, id LIMIT 50",
    "tenant_counts": "SELECT n_chars % 10 AS part, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE lang = 'en' AND source = 'src0' GROUP BY 1",
    "vectors_set": f"WITH {A.CHUNKS_SQL} SELECT collection || '/' || (id // 50) AS collection, CASE WHEN count(*) FILTER (embedding IS NULL AND id % 2 = 1) = 0 THEN 'embedded' ELSE 'chunked' END AS status, count(*) AS n FROM chunks GROUP BY 1",
    "text_checks": """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS words, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS unknown,
  array_to_string(list_filter([CASE WHEN contains(text, 'token =') THEN 'token =' END, CASE WHEN doc_id % 3 = 0 THEN 'ບັນຊຶ' END], lambda x: x IS NOT NULL), ',') AS forbidden FROM documents""",
    "cited_questions": f"""WITH {A.CHUNKS_SQL}, bt AS (SELECT item_id AS query_id, t AS term FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'))) AS t FROM benchmark WHERE item_id % 3 <> 0)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(t) DESC, t) <= 2), {lexical_sql('h', 'chunks', 1, 'bt')}
SELECT item_id AS qa_id, CASE WHEN item_id % 3 = 0 THEN item_id::VARCHAR ELSE coalesce(h.id::VARCHAR, '') END AS citations FROM benchmark LEFT JOIN h ON query_id = item_id""",
    "export_licenses": f"WITH {A.CHUNKS_SQL} SELECT DISTINCT license FROM chunks",
    "term_mining": f"""WITH {A.CHUNKS_SQL}, w AS (SELECT regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+') AS ws FROM chunks WHERE review <> 'rejected'),
i AS (SELECT ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT unnest([2, 3]) AS n)), g AS (SELECT array_to_string(ws[k:k + n - 1], ' ') AS term_seg FROM i WHERE length(ws[k]) >= 2 AND length(ws[k + 1]) >= 2 AND (n = 2 OR length(ws[k + 2]) >= 2))
SELECT replace(term_seg, ' ', '') AS term, term_seg, count(*) AS freq FROM g WHERE replace(term_seg, ' ', '') NOT IN (SELECT replace(p_name, ' ', '') FROM part) GROUP BY term_seg HAVING count(*) >= 2 ORDER BY freq DESC, term_seg LIMIT 50""",
    "glossary_expand": "SELECT page_id AS query_id, term FROM pages, (SELECT lower(n_name) AS term FROM nation UNION SELECT lang FROM documents UNION SELECT source FROM documents) WHERE contains(lower(url), term)",
    "glossary_questions": "SELECT item_id AS query_id, term FROM benchmark, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE contains(lower(text), lower(term))",
    "split_assign": f"WITH {QA_SQL}, f AS (SELECT qa_id, coalesce(document, qa_id::VARCHAR) AS document FROM qa LEFT JOIN parts ON id = citations[1]), u AS (SELECT *, {UNIT.format('document')} AS u FROM f) SELECT qa_id, document, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'dev' ELSE 'test' END AS split FROM u",
    "account_infer": f"SELECT p_partkey, code, {ATTRIBUTES} FROM (SELECT p_partkey, p_size::VARCHAR AS code FROM part)",
    "account_infer_mismatch": f"WITH {A.LEDGER_SQL}, b AS (SELECT account_code AS code, sum(debit) - sum(credit) AS balance FROM ledger GROUP BY 1), x AS (SELECT *, {ATTRIBUTES} FROM b) SELECT code AS account_code, CASE WHEN balance >= 0 THEN 'debit' ELSE 'credit' END AS side, normal_balance AS inferred FROM x WHERE (balance >= 0) <> (normal_balance = 'debit')",
    "upsert_ignore": """WITH b AS (SELECT DISTINCT c_nationkey::BIGINT AS k, c_mktsegment FROM customer), r AS (SELECT o_custkey % 40 AS k, 'MACHINERY' AS c_mktsegment, min(o_orderpriority) AS v FROM orders GROUP BY 1)
SELECT *, 'base' AS v FROM b UNION ALL SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = r.k AND b.c_mktsegment = r.c_mktsegment)""",
    "patch_update": "SELECT doc_id, CASE WHEN toxic = 1 THEN 9 ELSE quality END::INT AS quality, toxic <> 1 AS verified FROM labels",
    "verify_rows": "SELECT doc_id, toxic = 1 OR quality = 1 AS verified, CASE WHEN toxic = 1 THEN 'reviewer' END AS verified_by, CASE WHEN toxic = 1 THEN TIMESTAMP '2024-01-30 12:00:00' END AS verified_at FROM labels",
    "review_transitions": f"""WITH {A.CHUNKS_SQL} SELECT id, CASE lang WHEN 'de' THEN 'accepted' WHEN 'fr' THEN 'rejected' WHEN 'es' THEN 'edited' ELSE review END AS review, sha256(CASE WHEN lang = 'es' THEN upper(content) ELSE content END) AS sha256, embedding IS NOT NULL AND lang <> 'es' AS has_embedding, token_count, CASE WHEN lang = 'es' THEN 'en' ELSE lang END AS lang FROM chunks""",
    "bulk_accept": f"WITH {A.CHUNKS_SQL} SELECT id, CASE WHEN review = 'pending' AND collection = 'src0' AND token_count > 100 THEN 'accepted' ELSE review END AS review FROM chunks",
    "cascade_delete": """WITH gone AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer))
SELECT 'parents' AS what, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'children', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'references', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone)""",
    "report_merge": """SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN json_merge_patch(props::JSON, '{"reported":true}'::JSON)::VARCHAR ELSE props END AS props FROM events""",
    "replace_children": """WITH f AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT 'old' AS v, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM f)
UNION ALL SELECT 'new', count(*), count(DISTINCT o_orderkey) FROM f""",
    "retention": "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "export_chunks": f"WITH {A.CHUNKS_SQL} SELECT id, collection, license, review, sha256(content) AS sha256 FROM chunks WHERE review IN ('accepted', 'edited') AND license <> 'client-confidential'",
    "export_manifest": f"""WITH {A.CHUNKS_SQL}, u AS (SELECT id, collection, {UNIT.format('collection')} AS u FROM chunks WHERE review IN ('accepted', 'edited') AND license <> 'client-confidential'),
l AS (SELECT CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'dev' ELSE 'test' END AS file, id, '{{"id":' || id || ',"collection":"' || collection || '"}}' AS line FROM u),
p AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 67108864 AS part FROM l)
SELECT file, part::BIGINT AS part, count(*) AS records, sum(strlen(line) + 1)::BIGINT AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY id)) AS sha256 FROM p GROUP BY file, part""",
    "export_files": f"""WITH {A.CHUNKS_SQL}, u AS (SELECT id, content, {UNIT.format('collection')} AS u FROM chunks WHERE review IN ('accepted', 'edited') AND license <> 'client-confidential'),
l AS (SELECT CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'dev' ELSE 'test' END AS file, id, '{{"id":' || id || ',"content":' || to_json(content) || '}}' AS line FROM u),
p AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 262144 AS part FROM l)
SELECT file, part::BIGINT AS part, count(*) AS records, sum(strlen(line) + 1)::BIGINT AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY id)) AS sha256 FROM p GROUP BY file, part""",
    "export_card": "WITH m AS (@MANIFEST@), l AS (@LICENSES@) SELECT '0' AS place, '# Data card, version 1.0.0' AS line UNION ALL SELECT '1', '| file | records | bytes | sha256 |' UNION ALL SELECT '2', 'Licenses of the sources:' UNION ALL SELECT '1/' || file || '/' || part, '| ' || file || ' | ' || records || ' | ' || bytes || ' | hash |' FROM m UNION ALL SELECT '3/' || license, '- ' || license || ': ' || n || ' chunks' FROM l",
    "eval_set": """WITH a AS (SELECT (p_partkey % 997 + 100)::VARCHAR AS code, count(*) AS n_gold, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1)
SELECT code, CASE WHEN row_number() OVER (ORDER BY code) % 2 = 1 THEN 'What is account ' || code || '?' ELSE 'Which code has ' || name || '?' END AS question, n_gold FROM a WHERE regexp_matches(code, '^[0-9]{3,6}$')""",
}

ORACLE["export_card"] = ORACLE["export_card"].replace("@MANIFEST@", ORACLE["export_manifest"]).replace("@LICENSES@", f"WITH {A.CHUNKS_SQL} SELECT license, count(*) AS n FROM chunks GROUP BY license")
