"""Queries of assisted answering and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafmill.functions import texts
from sheafmill.operators import assist as ops
from sheafmill.operators import curation, dashboard, ingest, retrieval
from sheafmill.plans import adapters as A
from sheafmill.plans.curation import glossary
from sheafmill.sources import markdown, shared

T = A.table


def chat_prompts(spark, sf_dir):
    """A prompt a thread: its history, its last question, and up to three documents that begin with the question's first word."""
    m = T(spark, sf_dir, "conversations")
    last = m.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    questions = last.select(F.col("conv_id").alias("query_id"), "text")
    first = questions.select("query_id", F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).alias("word"))
    texts = T(spark, sf_dir, "documents")
    openings = texts.select("doc_id", F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).alias("word"), (F.xxhash64("doc_id") % 64).alias("salt"))
    firsts = ops.numbered(ops.numbered(openings, ["doc_id"], by=("word", "salt")).where("n <= 3"), ["doc_id"], by=("word",)).where("n <= 3").select("word", "doc_id", "n")
    won = first.join(firsts, "word").select("query_id", "doc_id", "n")
    hits = won.join(texts.select("doc_id", F.col("text").alias("content"), F.array("source").alias("path")), "doc_id").withColumn("origin", F.lit("dataset"))
    none = questions.select("query_id", F.lit("").alias("terms"))
    made = ops.prompts(questions, ops.context_blocks(hits), ops.histories(dashboard.last_messages(m)), none)
    return made.select("query_id", F.sha2("prompt", 256).alias("sha256"), F.length("prompt").cast("long").alias("n"))


def chat_turns(spark, sf_dir):
    """A turn a thread, for its last question, every third of which names an invoice: sources by search over what isn't rejected, the invoice, the glossary's
    terms, the history and the prompt."""
    m = T(spark, sf_dir, "conversations")
    asked = m.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("text"))
    asked = asked.withColumn("text", F.when(F.col("query_id") % 3 == 0, F.concat("text", F.lit(" inv-"), (F.col("query_id") * 4 + 1).cast("string"))).otherwise(F.col("text")))
    longest = F.array_sort(F.transform(F.array_distinct(texts.lexemes(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    asked = shared.written(asked.withColumn("terms", F.transform(F.slice(longest, 1, 3), lambda x: x["w"])), "chat-questions")
    live = A.chunks(spark, sf_dir).where("review <> 'rejected'")
    found = retrieval.lexical(asked, live, 5, "any").join(live.select("id", F.array("collection").alias("path"), "content"), "id")
    ledger = A.invoices(spark, sf_dir).select("ref", F.concat_ws(" ", "ref", "customer", "status", F.col("gross").cast("string")).alias("content"))
    named = curation.substrings_in(asked.select("query_id", "text"), glossary(spark, sf_dir))
    terms = named.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("terms"))
    turn = ops.chat_turns(asked, dashboard.last_messages(m), found, ledger, terms)
    cited = turn.sources.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "origin", "id"))), lambda x: F.concat(x["origin"], F.lit(":"), x["id"])), ",").alias("cited"))
    return turn.prompts.join(cited, "query_id", "left").select("query_id", F.coalesce("cited", F.lit("")).alias("cited"), F.sha2("prompt", 256).alias("sha256"), F.length("prompt").cast("long").alias("n"))


def promoted_answers(spark, sf_dir):
    return ops.promoted(T(spark, sf_dir, "conversations")).select("conv_id", "turn", "question", "verified")


def question_intents(spark, sf_dir):
    asks = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" outstanding for INV-"), F.col("doc_id").cast("string"), F.lit("?"))).when(F.col("doc_id") % 7 == 1, " Trial  balance").otherwise("")
    rows = T(spark, sf_dir, "documents").select("doc_id", F.explode(ops.intents(F.concat("text", asks))).alias("x"))
    return rows.select("doc_id", "x.tool", "x.argument")


def requests(spark, sf_dir):
    """Documents as requests of domains and roles in turn."""
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    return T(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), pick(["accounting", "accounting", "payroll", "law"], F.col("doc_id")).alias("domain"), pick(["accountant", "auditor", "tax_advisor", "bookkeeper", "guest"], F.col("doc_id")).alias("role"), "text")


def agent_requests(spark, sf_dir):
    return requests(spark, sf_dir).select("query_id", ops.request_status(F.col("domain"), F.col("role")).alias("status"))


def agent_tools(spark, sf_dir):
    """What the tools find for requests that are answered: codes of parts, and words of part names."""
    answered = requests(spark, sf_dir).where(ops.request_status(F.col("domain"), F.col("role")) == 200)
    chart = T(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).cast("string").alias("code"))
    terms = T(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return ops.tool_calls(answered, chart, terms).select("query_id", "tool", "input", F.array_join("found", ",").alias("found"))


def abstention_rate(spark, sf_dir):
    m = T(spark, sf_dir, "conversations").where("role = 'assistant'")
    return ops.abstention(m.withColumn("text", F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("That is Not in the Sources. "), "text")).otherwise(F.col("text"))))


def customers_named(spark, sf_dir):
    """Questions about orders that name their customer."""
    names = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer"))
    asked = T(spark, sf_dir, "orders").join(names, F.col("o_custkey") == F.col("customer_id")).where("o_orderstatus = 'P'")
    questions = asked.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("what does "), "customer", F.lit(" owe for it")).alias("text"))
    return ops.customers_named(questions, names)


def faithfulness(spark, sf_dir):
    scored = T(spark, sf_dir, "events").select("event_type", ops.judged(F.replace("props", F.lit('"k"'), F.lit('"score"'))).alias("x"))
    return ops.faithfulness(scored.select("event_type", "x.score"), "event_type")


def judge_answers(spark, sf_dir):
    """Event payloads read as judges' answers."""
    return T(spark, sf_dir, "events").select("event_id", ops.judged(F.replace("props", F.lit('"k"'), F.lit('"score"'))).alias("x")).select("event_id", F.col("x.score").cast("long").alias("score"))


def ingest_documents(spark, sf_dir):
    docs = A.chunks(spark, sf_dir).select("id", "collection", "content")
    return ingest.ingested(docs).documents.select("id", "collection", "sha256")


def authored(spark, sf_dir):
    """Documents as authored entries: every fifth line from the first on a heading of some level, every fourth of a five a row of a table, and blank lines between."""
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), ((F.col("doc_id") + i) % 5 + 1).cast("int")), F.lit(" "), F.substring(x, 1, 30))).when(i % 5 == 3, F.concat(F.lit("| "), x)).when(i % 7 == 6, "").otherwise(x)
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return T(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), body.alias("body"), F.concat(F.lit("kind-"), "lang").alias("kind"), F.lit("sop").alias("collection"))


def entry_outline(spark, sf_dir):
    """Blocks of entries under their headings."""
    rows = markdown.entry_blocks(authored(spark, sf_dir), "id")
    return rows.select("id", "block_no", "kind", "level", F.sha2("text", 256).alias("sha256"), F.array_join("path", " > ").alias("path"))


def entries_saved(spark, sf_dir):
    """All entries are created; those whose document is labelled toxic are then updated, with the last line of their body alone. What is there afterwards."""
    entries = authored(spark, sf_dir)
    none = ingest.entry_chunks(entries.where("false"))
    first = ingest.entries_saved(entries, entries.where("false").select("id", "title", "collection", F.col("kind").alias("meta")), none)
    toxic = T(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    changed = entries.join(toxic, "id", "left_semi").withColumn("body", F.concat(F.lit("changed: "), F.element_at(F.split("body", "\n"), -1))).withColumn("kind", F.lit("changed"))
    after = ingest.entries_saved(changed, shared.written(first.documents, "entries"), shared.written(first.chunks, "entry-chunks"))
    per = after.chunks.groupBy(F.col("doc_id").alias("id")).agg(F.min("meta").alias("chunk_meta"), F.min("review").alias("review"), F.max(F.contains("content", F.lit("changed: "))).alias("changed"))
    told = after.events.withColumnRenamed("event_type", "event")
    return after.documents.join(per, "id", "left").join(told, "id", "left").select("id", "title", "meta", "chunk_meta", "review", "changed", "event")


def ingest_preview(spark, sf_dir):
    return ingest.previewed(A.chunks(spark, sf_dir).select("id", "collection", "content"))


QUERIES = {f.__name__: f for f in (chat_prompts, chat_turns, promoted_answers, question_intents, agent_requests, agent_tools, abstention_rate, customers_named, faithfulness, judge_answers, ingest_documents, entry_outline, entries_saved, ingest_preview)}

AUTHORED_SQL = """lines AS (SELECT doc_id AS id, source, lang, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS m FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
made AS (SELECT id, source, lang, i, m, CASE WHEN i % 5 = 0 THEN repeat('#', (((id + i) % 5) + 1)::INT) || ' ' || substr(x, 1, 30) WHEN i % 5 = 3 THEN '| ' || x WHEN i % 7 = 6 THEN '' ELSE x END AS line FROM lines)"""

ORACLE = {
    "entry_outline": f"""WITH {AUTHORED_SQL}, k AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*$') THEN 'blank' WHEN regexp_matches(line, '^#{{1,4}}\\s+') THEN 'heading' WHEN starts_with(trim(line), '|') THEN 'table' ELSE 'prose' END AS kind FROM made),
b AS (SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^#+')) END AS level, trim(regexp_extract(line, '^#{{1,4}}\\s+(.*)$', 1)) AS name,
  count(*) FILTER (o) OVER (PARTITION BY id ORDER BY i) AS block FROM (SELECT *, kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY id ORDER BY i) AS o FROM k)),
g AS (SELECT id, source, block, kind, min(level) AS level, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS text, min(name) AS name FROM b WHERE kind <> 'blank' GROUP BY id, source, block, kind),
p AS (SELECT g.id, g.block, list(h.name ORDER BY h.level) FILTER (h.name <> '') AS above FROM g JOIN b h ON h.id = g.id AND h.kind = 'heading' AND h.i <= g.i
  WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.id = g.id AND o.kind = 'heading' AND o.i > h.i AND o.i <= g.i AND o.level <= h.level) GROUP BY g.id, g.block)
SELECT g.id, row_number() OVER (PARTITION BY g.id ORDER BY g.block) AS block_no, kind, level::INT AS level, sha256(CASE WHEN kind = 'heading' THEN name ELSE text END) AS sha256,
  array_to_string(list_concat(CASE WHEN source <> '' THEN [source] ELSE [] END, coalesce(above, [])), ' > ') AS path FROM g LEFT JOIN p USING (id, block)""",
    "entries_saved": f"""WITH {AUTHORED_SQL}, t AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1),
e AS (SELECT id, source AS title, lang, count(*) FILTER (NOT regexp_matches(line, '^\\s*$') AND NOT regexp_matches(line, '^#{{1,4}}\\s+')) > 0 AS has_text FROM made GROUP BY ALL)
SELECT id, title, '{{"manual":true,"knowledge_kind":"' || kind || '"}}' AS meta, CASE WHEN has_text OR changed THEN '{{"manual":true,"knowledge_kind":"' || kind || '"}}' END AS chunk_meta, CASE WHEN has_text OR changed THEN 'accepted' END AS review,
  CASE WHEN has_text OR changed THEN changed END AS changed, CASE WHEN changed THEN 'knowledge.updated' END AS event
FROM (SELECT e.*, t.id IS NOT NULL AS changed, CASE WHEN t.id IS NOT NULL THEN 'changed' ELSE 'kind-' || lang END AS kind FROM e LEFT JOIN t USING (id))""",
    "chat_prompts": """WITH q AS (SELECT conv_id AS query_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id), f AS (SELECT *, lower(split_part(trim(text), ' ', 1)) AS word FROM q),
d AS (SELECT doc_id, source, text AS content, lower(split_part(trim(text), ' ', 1)) AS word FROM documents), h AS (SELECT query_id, doc_id, source, content, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM f JOIN d USING (word) QUALIFY n <= 3),
c AS (SELECT query_id, string_agg('[' || n || '] ' || source || chr(10) || substr(content, 1, 700), chr(10) || chr(10) ORDER BY n) AS context FROM h GROUP BY query_id),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), m AS (SELECT conv_id AS query_id, string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN substr(text, 1, 300) ELSE text END, chr(10) ORDER BY turn) AS history FROM b WHERE back BETWEEN 2 AND 8 GROUP BY conv_id),
p AS (SELECT query_id, concat_ws(chr(10) || chr(10), CASE WHEN length(history) > 0 THEN 'History' || chr(10) || history END, CASE WHEN length(context) > 0 THEN 'Sources' || chr(10) || context END, CASE WHEN length(text) > 0 THEN 'Question' || chr(10) || text END) AS prompt
  FROM q LEFT JOIN c USING (query_id) LEFT JOIN m USING (query_id)) SELECT query_id, sha256(prompt) AS sha256, length(prompt)::BIGINT AS n FROM p""",
    "chat_turns": f"""WITH {A.CHUNKS_SQL}, {A.INVOICES_SQL}, q0 AS (SELECT conv_id AS query_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
q AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN text || ' inv-' || (query_id * 4 + 1) ELSE text END AS text FROM q0),
w AS (SELECT * FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[^\\s\\p{{Z}}\\x{{85}}\\x0B]+'))) AS term FROM q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) <= 3),
t AS (SELECT id, unnest(regexp_extract_all(lower(content), '[^\\s\\p{{Z}}\\x{{85}}\\x0B]+')) AS term FROM chunks WHERE review <> 'rejected'),
d AS (SELECT query_id, id, count(*) AS k FROM t JOIN w USING (term) GROUP BY query_id, id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, id) <= 5),
s AS (SELECT query_id, 0 AS late, -k AS o, id AS o2, 'dataset' AS origin, id::VARCHAR AS id, collection AS path, substr(content, 1, 700) AS content FROM d JOIN chunks USING (id)
  UNION ALL SELECT query_id, 1, 0, 0, 'erp', ref, 'ledger', ref || ' ' || customer || ' ' || status || ' ' || gross FROM q JOIN invoices ON contains(upper(text), ref) AND regexp_extract(upper(text), 'INV-\\S+') = ref),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, o, o2) AS n FROM s),
c AS (SELECT query_id, string_agg(origin || ':' || id, ',' ORDER BY n) AS cited, string_agg('[' || n || '] ' || path || chr(10) || content, chr(10) || chr(10) ORDER BY n) AS context FROM n GROUP BY query_id),
g AS (SELECT query_id, string_agg(term, ', ' ORDER BY term) AS terms FROM q, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE contains(lower(text), lower(term)) GROUP BY query_id),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), m AS (SELECT conv_id AS query_id, string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN substr(text, 1, 300) ELSE text END, chr(10) ORDER BY turn) AS history FROM b WHERE back BETWEEN 2 AND 8 GROUP BY conv_id),
p AS (SELECT query_id, cited, concat_ws(chr(10) || chr(10), CASE WHEN length(history) > 0 THEN 'History' || chr(10) || history END, CASE WHEN length(terms) > 0 THEN 'Terms' || chr(10) || terms END,
  CASE WHEN length(context) > 0 THEN 'Sources' || chr(10) || context END, CASE WHEN length(text) > 0 THEN 'Question' || chr(10) || text END) AS prompt FROM q LEFT JOIN c USING (query_id) LEFT JOIN m USING (query_id) LEFT JOIN g USING (query_id))
SELECT query_id, coalesce(cited, '') AS cited, sha256(prompt) AS sha256, length(prompt)::BIGINT AS n FROM p""",
    "promoted_answers": "SELECT * FROM (SELECT conv_id, turn, (SELECT u.text FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn < c.turn ORDER BY u.turn DESC LIMIT 1) AS question, false AS verified FROM conversations c WHERE role = 'assistant') WHERE question IS NOT NULL",
    "question_intents": r"""WITH documents_ AS (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' outstanding for INV-' || doc_id || '?' WHEN 1 THEN ' Trial  balance' ELSE '' END AS text FROM documents)
SELECT doc_id, tool, argument FROM (SELECT doc_id, 'outstanding' AS tool, NULL AS argument, regexp_matches(text, '(?i)outstanding') AS hit FROM documents_
UNION ALL SELECT doc_id, 'trial_balance', NULL, regexp_matches(text, '(?i)trial\s*balance') FROM documents_ UNION ALL SELECT doc_id, 'invoice_lookup', regexp_extract(text, '(?i)INV-\S+'), regexp_matches(text, '(?i)INV-\S+') FROM documents_) WHERE hit""",
    "agent_requests": """SELECT doc_id AS query_id, CASE WHEN doc_id % 4 = 3 THEN 404 WHEN doc_id % 4 = 2 THEN 409 WHEN doc_id % 5 = 4 THEN 404 ELSE 200 END::INT AS status FROM documents""",
    "agent_tools": r"""WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 4 < 2 AND doc_id % 5 < 4),
x AS (SELECT doc_id, m, min(i) AS i FROM (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\b\d{4,6}\b') AS ms FROM a)) GROUP BY doc_id, m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 3),
c AS (SELECT DISTINCT (p_partkey + 1000)::VARCHAR AS code FROM part), h AS (SELECT doc_id, m, code FROM x JOIN c ON starts_with(code, m) QUALIFY row_number() OVER (PARTITION BY doc_id, m ORDER BY code) <= 5),
t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part), g AS (SELECT doc_id, substr(text, 1, 60) AS input, term FROM a, t WHERE contains(lower(substr(text, 1, 60)), lower(term)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY term) <= 5)
SELECT doc_id AS query_id, 'coa_search' AS tool, m AS input, string_agg(code, ',' ORDER BY code) AS found FROM h GROUP BY doc_id, m
UNION ALL SELECT doc_id, 'glossary_lookup', input, string_agg(term, ',' ORDER BY term) FROM g GROUP BY doc_id, input""",
    "abstention_rate": "SELECT count(*) AS n, round(avg(CASE WHEN conv_id % 4 = 0 OR regexp_matches(text, '(?i)not in the sources|cannot answer|ບໍ່ພົບ') THEN 1 ELSE 0 END), 4) AS rate FROM conversations WHERE role = 'assistant'",
    "customers_named": "SELECT o_orderkey AS query_id, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'",
    "faithfulness": "SELECT event_type, count(*) AS n, round(avg(greatest(1, least(5, coalesce((props->>'$.k')::INT, 1))) / 5), 4) AS faithfulness FROM events GROUP BY event_type",
    "judge_answers": "SELECT event_id, greatest(1, least(5, coalesce((props->>'$.k')::INT, 1)))::BIGINT AS score FROM events",
    "ingest_documents": "SELECT min(doc_id) AS id, source AS collection, sha256(text) AS sha256 FROM documents GROUP BY 2, 3",
}
