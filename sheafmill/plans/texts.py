"""Queries of text functions, parsers and chunkers over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafmill.functions import texts as fn
from sheafmill.operators import chunking, curation
from sheafmill.plans import adapters as A
from sheafmill.sources import files, markdown

T = A.table


def docs(spark, sf_dir):
    return T(spark, sf_dir, "documents")


#: What is put behind every document's text, by doc_id modulo their number, as the tables hold neither the script nor its defects.
MARRED = ("", " \u200b\ufeffa", " ກັັ ບັ", " ກ ັ x\u200d", " " + "ໂຄງການບັນຊີ " * 400)


def marred(spark, sf_dir):
    endings = F.element_at(F.array(*map(F.lit, MARRED)), (F.pmod("doc_id", F.lit(len(MARRED))) + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.concat("text", endings).alias("text"))


def html_to_text(spark, sf_dir):
    """Whole pages; what quotes them cuts its own excerpts."""
    return T(spark, sf_dir, "pages").select("page_id", fn.page_text(F.col("html"), None, None).alias("text"))


def knowledge_blocks(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    return markdown.entry_blocks(rows).select("doc_id", "block_no", "kind", F.sha2("text", 256).alias("sha256"))


def markdown_blocks(spark, sf_dir):
    rows = markdown.markdown_blocks(docs(spark, sf_dir)).select("doc_id", F.posexplode("blocks").alias("n", "b"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "b.kind", "b.level", F.sha2("b.text", 256).alias("sha256"))


def block_chunks(spark, sf_dir):
    made = chunking.block_chunks(markdown.markdown_blocks(docs(spark, sf_dir)))
    return made.select("doc_id", "seq", "kind", "token_count", F.sha2("content", 256).alias("sha256"))


def sentence_chunks(spark, sf_dir):
    return chunking.sentence_chunks(docs(spark, sf_dir)).select("doc_id", "seq", "token_count", "n_sentences", F.sha2("content", 256).alias("sha256"))


def spellcheck(spark, sf_dir):
    """Words of question texts against those of all pages' names."""
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    words = T(spark, sf_dir, "benchmark").select(F.explode(fn.tokens(F.col("text"))).alias("w")).select(clean("w").alias("word")).where("word <> ''")
    known = T(spark, sf_dir, "conversations").select(F.explode(fn.tokens(F.col("text"))).alias("w")).select(clean("w").alias("word")).where("word <> ''")
    return curation.spell_checked(words, known, "abcdefghijklmnopqrstuvwxyz").select("word", "in_dictionary", F.array_join("suggestions", ",").alias("suggestions"))


def coa_detect(spark, sf_dir):
    """Pages' word tables of three columns, judged as charts of accounts."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("table_id"), F.filter(F.transform(F.split("text", "\n"), lambda line: F.transform(F.split(line, "\\|"), lambda c: F.trim(c))), lambda r: F.size(r) > 1).alias("cells"))
    return curation.account_tables(rows.where("size(cells) > 0")).select("table_id", "is_coa", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    "lang_census": lambda s, d: marred(s, d).select("doc_id", fn.language(F.col("text")).alias("lang")),
    "defect_scan": lambda s, d: marred(s, d).select("doc_id", fn.defect_counts(F.col("text")).alias("of")).select("doc_id", "of.*"),
    "defect_fix": lambda s, d: marred(s, d).select("doc_id", F.sha2(fn.defects_fixed(F.col("text")), 256).alias("sha256")),
    "normalise_text": lambda s, d: marred(s, d).select("doc_id", F.sha2(fn.normalised(F.col("text")), 256).alias("sha256"), F.length(fn.normalised(F.col("text"))).cast("long").alias("n")),
    "amount_literals": lambda s, d: docs(s, d).select("doc_id", fn.amounts(F.col("text")).alias("a")).where("size(a) > 0").select("doc_id", F.size("a").cast("long").alias("n"), F.array_join(F.array_sort("a"), ";").alias("amounts")),
    "sentence_counts": lambda s, d: docs(s, d).select("doc_id", F.size(fn.sentences(F.col("text"))).cast("long").alias("n"), F.sha2(F.array_join(fn.sentences(F.col("text")), "\u241e"), 256).alias("sha256")),
    "account_codes": lambda s, d: docs(s, d).select("doc_id", F.array_join(fn.account_codes_in(F.col("text")), ",").alias("codes")),
    "page_links": lambda s, d: files.page_links(T(s, d, "pages")),
    **{f.__name__: f for f in (html_to_text, knowledge_blocks, markdown_blocks, block_chunks, sentence_chunks, spellcheck, coa_detect)},
}

MARKS = "".join(fn.COMBINING_MARKS)
DOUBLED = "|".join(f"{m}{m}+" for m in MARKS)
ZW = "\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}"
NUMBER = "[0-9໐-໙]+(?:[.,][0-9໐-໙]+)*"
AMOUNT = f"(?:{NUMBER}\\s*{fn.CURRENCY}|{fn.CURRENCY}\\s*{NUMBER}|[0-9໐-໙]{{1,3}}(?:[.,][0-9໐-໙]{{3}})+(?:[.,][0-9໐-໙]+)?)"


def fixed_sql() -> str:
    out = f"regexp_replace(text, '[{ZW}]', '', 'g')"
    for m in MARKS:
        out = f"regexp_replace({out}, '{m}{m}+', '{m}', 'g')"
    return f"regexp_replace({out}, '[ \\t]+([{fn.COMBINING}])', '\\1', 'g')"


def page_sql() -> str:
    return stripped_sql("html", ("script", "style", "nav", "header", "footer", "aside"))


def stripped_sql(out: str, without: tuple[str, ...] = ()) -> str:
    """Text without tags, entities and runs of blanks, and without the contents of some elements."""
    for tag in without:
        out = f"regexp_replace({out}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '&#x?\\d+;', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')"


ENDS = "[^.!?ຯ\\n]*[.!?ຯ\\n]|[^.!?ຯ\\n]+$"
SENTENCES = f"list_filter(list_transform(regexp_extract_all(text, '{ENDS}'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"

MARRED_SQL = "marred AS (SELECT doc_id, text || [" + ", ".join(f"'{m}'" for m in MARRED) + f"][doc_id % {len(MARRED)} + 1] AS text FROM documents)"

ORACLE = {
    "lang_census": f"""WITH {MARRED_SQL}, c AS (SELECT doc_id, len(regexp_extract_all(text, '[{fn.LAO}]')) AS lao, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS latin FROM marred)
SELECT doc_id, CASE WHEN lao = 0 THEN 'en' WHEN latin = 0 THEN 'lo' WHEN lao / (lao + latin) >= 0.9 THEN 'lo' WHEN lao / (lao + latin) <= 0.1 THEN 'en' ELSE 'mixed' END AS lang FROM c""",
    "defect_scan": f"""WITH {MARRED_SQL}, c AS (SELECT doc_id, len(regexp_extract_all(text, '[{ZW}]'))::BIGINT AS zero_width, len(regexp_extract_all(text, '{DOUBLED}'))::BIGINT AS doubled_marks, len(regexp_extract_all(text, '[ \\t]+[{fn.COMBINING}]'))::BIGINT AS blank_before_mark FROM marred)
SELECT *, zero_width + doubled_marks + blank_before_mark AS total FROM c""",
    "defect_fix": f"WITH {MARRED_SQL} SELECT doc_id, sha256({fixed_sql()}) AS sha256 FROM marred",
    "normalise_text": f"WITH {MARRED_SQL}, n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), '[\\s\\p{{Z}}\\x{{85}}\\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM marred) SELECT doc_id, sha256(t) AS sha256, length(t)::BIGINT AS n FROM n",
    "amount_literals": f"WITH a AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{AMOUNT}'), lambda x: trim(x)))) AS a FROM documents) SELECT doc_id, len(a)::BIGINT AS n, array_to_string(a, ';') AS amounts FROM a WHERE len(a) > 0",
    "sentence_counts": f"SELECT doc_id, len({SENTENCES})::BIGINT AS n, sha256(array_to_string({SENTENCES}, '\u241e')) AS sha256 FROM documents",
    "account_codes": r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '\b\d{4,6}\b') AS ms FROM documents), x AS (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM m),
f AS (SELECT doc_id, m, min(i) AS i FROM x GROUP BY doc_id, m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 3), c AS (SELECT doc_id, string_agg(m, ',' ORDER BY i) AS codes FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(codes, '') AS codes FROM documents LEFT JOIN c USING (doc_id)""",
    "spellcheck": r"""WITH w AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(lower(text), '[^\s\p{Z}\x{85}\x0B]+')), '[^a-z]', '', 'g') AS word FROM benchmark),
d AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(lower(text), '[^\s\p{Z}\x{85}\x0B]+')), '[^a-z]', '', 'g') AS entry FROM conversations),
u AS (SELECT word FROM w WHERE word <> '' AND word NOT IN (SELECT entry FROM d)),
n AS (SELECT word, list(entry ORDER BY entry) AS es FROM u JOIN d ON entry <> '' AND abs(length(word) - length(entry)) <= 1 AND damerau_levenshtein(word, entry) = 1 GROUP BY word)
SELECT w.word, w.word IN (SELECT entry FROM d) AS in_dictionary, coalesce(array_to_string(es[1:5], ','), '') AS suggestions FROM w LEFT JOIN n USING (word) WHERE w.word <> ''""",
    "sentence_chunks": f"""WITH RECURSIVE s AS (SELECT doc_id, {SENTENCES} AS ss FROM documents),
c AS (SELECT doc_id, ss, list_transform(ss, lambda x: len(regexp_extract_all(x, '[^\\s\\p{{Z}}\\x{{85}}\\x0B]+'))) AS ns FROM s WHERE len(ss) > 0),
p AS (SELECT doc_id, ss, ns, list_transform(range(0, len(ns) + 1), lambda k: coalesce(list_sum(ns[1:k]), 0)) AS sums FROM c),
w AS (SELECT doc_id, 0 AS seq, 0 AS low, greatest(1, len(list_filter(sums, lambda v: v <= 400)) - 1) AS high FROM p
  UNION ALL SELECT doc_id, seq + 1, low, greatest(low + 1, len(list_filter(sums, lambda v: v <= sums[low + 1] + 400)) - 1) FROM (
    SELECT w.doc_id, seq, sums, greatest(w.low + 1, len(list_filter(sums, lambda v: v <= sums[high + 1] - 60)) - 1) AS low FROM w JOIN p ON p.doc_id = w.doc_id WHERE high < len(ns)))
SELECT w.doc_id, seq::BIGINT AS seq, (sums[high + 1] - sums[low + 1])::BIGINT AS token_count, (high - low)::BIGINT AS n_sentences, sha256(array_to_string(ss[low + 1:high], ' ')) AS sha256 FROM w JOIN p ON p.doc_id = w.doc_id""",
    "page_links": rf"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href="[^"]+"[^>]*>.*?</a>') AS xs FROM pages),
x AS (SELECT page_id, unnest(xs) AS a, generate_subscripts(xs, 1) - 1 AS n FROM a), h AS (SELECT *, regexp_extract(a, '(?is)href="([^"]+)"', 1) AS href FROM x), t AS (SELECT *, regexp_extract(href, '[?&]uddg=([^&]+)', 1) AS target FROM h)
SELECT page_id, n, CASE WHEN target <> '' THEN url_decode(target) WHEN starts_with(href, '//') THEN 'https:' || href ELSE href END AS url, {stripped_sql('a')} AS title FROM t""",
    "html_to_text": f"SELECT page_id, {page_sql()} AS text FROM pages",
}
