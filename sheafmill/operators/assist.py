"""Data contracts of assisted answering: intents, sources, prompts, judged answers. Texts are assembled; none is generated."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafmill.functions import measures, segmentation, texts
from sheafmill.sources import shared

# What counts as which question, and how much of a source goes into a prompt.
OUTSTANDING = "(?i)ຄ້າງຊຳລະ|ຄ້າງຈ່າຍ|ໜີ້ຄ້າງ|ຍັງຕິດໜີ້|outstanding"
TRIAL_BALANCE = "(?i)ດຸ່ນດ່ຽງທົດລອງ|trial\\s*balance"
BALANCE = "ຍອດ(?:ເຫຼືອ)?\\s*(?:ຂອງ)?\\s*ບັນຊີ\\s*(?:ເລກ)?\\s*(\\d{2,4})"
INVOICE = "(?i)INV-\\S+"
INVOICES_OF = "ໃບເກັບເງິນ.*(ຂອງ|ລູກຄ້າ)"
CAPS = {"dataset": 700, "web": 1600, "erp": 1600}
#: Words of a dictionary that are broadcast.
DICTIONARY_WORDS = 1_000_000


def intents(question: Column) -> Column:
    """Ledger questions that a text asks, with their arguments."""
    invoice, code = F.regexp_extract(question, f"({INVOICE})", 1), F.regexp_extract(question, BALANCE, 1)
    one = lambda name, when, arg: F.when(when, F.struct(F.lit(name).alias("tool"), arg.alias("argument")))
    none = F.lit(None).cast("string")
    found = F.array(one("outstanding", question.rlike(OUTSTANDING), none), one("trial_balance", question.rlike(TRIAL_BALANCE), none), one("account_balance", code != "", code),
                    one("invoice_lookup", (invoice != "") | question.rlike(INVOICES_OF), F.nullif(invoice, F.lit(""))))
    return F.filter(found, lambda x: x.isNotNull())


def customers_named(questions: DataFrame, customers: DataFrame) -> DataFrame:
    """(query_id, customer): the first customer, by id, whose distinctive word a question holds; found by the question's substrings."""
    from sheafmill.operators import curation

    cores = customers.select("customer_id", "customer", texts.core_name(F.col("customer")).alias("term")).where("term <> ''")
    hits = curation.substrings_in(questions, cores.select("term").distinct()).join(questions.select("query_id", "text"), "query_id").where(F.contains("text", "term"))
    return hits.join(cores, "term").groupBy("query_id").agg(F.min_by("customer", "customer_id").alias("customer"))


def numbered(sources: DataFrame, order: list, start: int = 0, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Citation numbers from start + 1 on, in order, within a query."""
    return sources.withColumn("n", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + start).cast("long"))


def context_blocks(sources: DataFrame) -> DataFrame:
    """(query_id, context): numbered sources as text, each cut to its origin's cap, in order. Sources have n, origin, path, content."""
    cap = F.coalesce(*[F.when(F.col("origin") == k, F.lit(v)) for k, v in CAPS.items()], F.lit(700))
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.array_join("path", " › "), F.lit("\n"), F.expr("substr(content, 1, cap)"))
    return sources.withColumn("cap", cap).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame, histories: DataFrame, terms: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt) of system part (query_id, system), history, terms, context and question, absent parts left out."""
    rows = questions.join(contexts, "query_id", "left").join(histories, "query_id", "left").join(terms, "query_id", "left")
    rows = rows.withColumn("system", F.lit(None).cast("string")) if systems is None else rows.join(systems, "query_id", "left")
    part = lambda title, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"{title}\n"), F.col(c)))
    return rows.select("query_id", F.concat_ws("\n\n", part("System", "system"), part("History", "history"), part("Terms", "terms"), part("Sources", "context"), part("Question", "text")).alias("prompt"))


class Turn(NamedTuple):
    """A chat turn of each question: its numbered sources (query_id, n, origin, id, path, content), and its prompt (query_id, prompt)."""

    sources: DataFrame
    prompts: DataFrame


def chat_turns(questions: DataFrame, messages: DataFrame, hits: DataFrame, ledger: DataFrame, terms: DataFrame) -> Turn:
    """What a chat turn works with, put together: the sources found for each question (query_id, text), then what the ledger has on the invoices that it
    names, numbered on; the thread's last messages; the glossary's terms (query_id, terms); and the prompt made of these. `hits` are what a search found (query_id, id,
    rank, path, content), `ledger` is a source an invoice (ref, content), and `messages` a thread's last ones (conv_id, place, role, text). A question without hits,
    invoices or history has no such part."""
    found = hits.select("query_id", "rank", F.lit("dataset").alias("origin"), F.col("id").cast("string").alias("id"), "path", "content")
    named = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(INVOICE.removeprefix("(?i)")), F.lit(0)))).alias("ref"))
    booked = named.join(ledger.withColumn("ref", F.upper("ref")), "ref").select("query_id", F.lit(None).cast("long").alias("rank"), F.lit("erp").alias("origin"), F.col("ref").alias("id"), F.array(F.lit("ledger")).alias("path"), "content")
    sources = shared.written(numbered(found.unionByName(booked), [F.col("rank").asc_nulls_last(), "id"]).drop("rank"), "turn-sources")
    return Turn(sources, prompts(questions.select("query_id", "text"), context_blocks(sources), histories(messages), terms))


def histories(messages: DataFrame) -> DataFrame:
    """(query_id, history) of a thread's messages (conv_id, place, role, text) in order."""
    line = F.struct("place", F.concat("role", F.lit(": "), "text").alias("t"))
    return messages.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n").alias("history"))


def judged(answers: Column) -> Column:
    """score (1 to 5, 1 by default) and reason of a judge's JSON answer; what isn't JSON counts 1 and is its own reason."""
    found = F.from_json(answers, "score int, reason string")
    return F.struct(measures.clamp(found["score"], 1, 5, 1).alias("score"), F.coalesce(found["reason"], F.substring(answers, 1, 500)).alias("reason"))


def promoted(messages: DataFrame, verified: bool = False) -> DataFrame:
    """QA rows of answers and the questions before them; of the sources only those of the dataset are citations."""
    from sheafmill.operators import dashboard

    rows = dashboard.latest_before(messages, F.col("role") == "assistant", F.col("role") == "user").where("question IS NOT NULL")
    own = F.transform(F.filter("sources", lambda s: s["origin"] == "dataset"), lambda s: s["id"]) if "sources" in messages.columns else F.array().cast("array<string>")
    return rows.select("conv_id", "turn", "question", F.col("text").alias("answer"), own.alias("citations"), F.lit(verified).alias("verified"))


def abstention(answers: DataFrame, marks: str = "(?i)not in the sources|cannot answer|ບໍ່ພົບ") -> DataFrame:
    """Share of answers that abstain; null if there are none."""
    return answers.agg(F.count("*").alias("n"), F.round(F.avg(F.col("text").rlike(marks).cast("int")), 4).alias("rate"))


# Roles, tools, collections and domains by state; only active domains have any of them.
ROLES = ("accountant", "auditor", "financial_consultant", "erp_consultant", "bookkeeper", "cfo_assistant", "tax_advisor", "financial_analyst")
TOOLS = ("coa_search", "glossary_lookup", "vat_calc", "doc_search")
COLLECTIONS = ("lao-accounting-law", "coa", "tax", "sop", "lao-style")
ACTIVE = {"accounting": (ROLES, TOOLS, COLLECTIONS)}
PLANNED = (
    "lao-tax", "ifrs", "financial-reporting", "inventory", "pos", "purchasing", "sales", "crm", "payroll", "hr", "fixed-assets", "banking", "treasury", "manufacturing", "projects", "hotel", "restaurant",
    "dms", "bi", "sysadmin",
)
LOOKED_UP = 60


def request_status(domain: Column, role: Column) -> Column:
    """200, or why a request (domain, role) is refused: 404 for an unknown one, 409 for a domain that is only planned, 422 for a role that
    the domain hasn't."""
    allowed = F.lit(False)
    for k, (roles, _, _) in ACTIVE.items():
        allowed = allowed | ((domain == k) & role.isin(*roles))
    known = F.coalesce(domain.isin(*ACTIVE, *PLANNED), F.lit(False))
    return F.when(~known, 404).when(domain.isin(*PLANNED), 409).when(~F.coalesce(role.isin(*ROLES), F.lit(False)), 404).when(~allowed, 422).otherwise(200)


def tool_calls(requests: DataFrame, chart: DataFrame, terms: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, tool, input, found): what the tools of a request's domain find before it is answered: accounts by the codes in the question, and
    terms in its first `LOOKED_UP` characters, `most` of each. Requests have query_id, domain, text; the chart code; terms term."""
    from sheafmill.operators import curation

    with_tool = lambda tool: [k for k, (_, tools, _) in ACTIVE.items() if tool in tools]
    asked = requests.where(F.col("domain").isin(*with_tool("coa_search"))).select("query_id", F.explode(texts.account_codes_in(F.col("text"))).alias("input"))
    openings = chart.select("code", F.explode(F.transform(F.sequence(F.lit(4), F.lit(6)), lambda n: F.substr("code", F.lit(1), n))).alias("input")).distinct()
    accounts = numbered(asked.join(openings, "input"), ["code"], by=("query_id", "input")).where(F.col("n") <= most)
    accounts = accounts.groupBy("query_id", "input").agg(F.array_sort(F.collect_list("code")).alias("found")).select("query_id", F.lit("coa_search").alias("tool"), "input", "found")
    opening = F.substring("text", 1, LOOKED_UP)
    looked = requests.where(F.col("domain").isin(*with_tool("glossary_lookup"))).select("query_id", opening.alias("text"))
    named = numbered(curation.substrings_in(looked, terms), ["term"]).where(F.col("n") <= most)
    named = named.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("found")).join(looked, "query_id").select("query_id", F.lit("glossary_lookup").alias("tool"), F.col("text").alias("input"), "found")
    return accounts.unionByName(named)


def cited(qa: DataFrame, rows: DataFrame) -> DataFrame:
    """qa (qa_id, citations, terms) with citations resolved: those given, else the top lexical hit for its terms; empty if there is none."""
    from sheafmill.operators import retrieval

    open_ = qa.where(F.size("citations") == 0).select(F.col("qa_id").alias("query_id"), "terms")
    top = retrieval.lexical(open_, rows, 1).select(F.col("query_id").alias("qa_id"), F.array("id").alias("_hit"))
    return qa.join(top, "qa_id", "left").select("qa_id", F.when(F.size("citations") > 0, F.col("citations")).otherwise(F.coalesce("_hit", F.array().cast("array<bigint>"))).alias("citations"))


def faithfulness(answers: DataFrame, *by: str) -> DataFrame:
    """Number and mean of judged scores (score, 1 to 5) as shares of 5, by group."""
    return answers.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("score") / 5), 4).alias("faithfulness"))


def parsed(answer: Column, schema: str, /, **defaults: str) -> Column:
    """The fields of a model's JSON answer, with defaults for those that are absent, and the start of an answer that isn't such as `error`."""
    found = F.from_json(answer, schema)
    fields = [f.split()[0] for f in schema.split(", ")]
    empty = F.forall(F.array(*[found[f].isNull() for f in fields]), lambda x: x)
    return F.struct(*[F.coalesce(found[f], F.lit(defaults.get(f))).alias(f) for f in fields], F.when(empty, F.substring(answer, 1, 500)).alias("error"))


def checked_texts(
    rows: DataFrame, dictionary: DataFrame, forbidden: list[str], key: str = "id", text: str = "content", tokens: Callable[[Column], Column] = texts.tokens, by: segmentation.Segmenter | None = None
) -> DataFrame:
    """(key, words, unknown, forbidden): how many different words of the script a text has in its normal form, how many of them the dictionary (word)
    lacks, and which listed forms it holds. Words are those that `tokens` gives, or those of a segmenter, whose dictionary is bounded: then texts are checked where they lie, in one pass, and none of
    their words is shuffled."""
    from sheafmill.operators import curation

    normal = texts.made_once(rows, "content", texts.normalised(F.col(text)), key)
    held = curation.forms_held(forbidden, "content").alias("forbidden")
    if by is not None:
        found = segmentation.checked(F.col("content"), by, segmentation.word_list(dictionary))
        return normal.select(key, found.alias("found"), held).select(key, "found.words", "found.unknown", "forbidden")
    known = shared.written(dictionary.select("word").where("word IS NOT NULL").distinct(), "dictionary")
    known = shared.small_or_shuffled(known, DICTIONARY_WORDS, F.octet_length("word")).withColumn("known", F.lit(True))
    words = texts.once_exploded(normal, "_pos", "word", F.array_distinct(tokens(F.col("content"))), key).where(F.col("word").rlike(f"[{texts.LAO}]"))
    counts = words.join(known, "word", "left").groupBy(key).agg(F.count("*").alias("words"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return normal.select(key, held).join(counts, key, "left").fillna(0, ["words", "unknown"]).select(key, "words", "unknown", "forbidden")


def canonical(spark: SparkSession) -> DataFrame:
    """The fixed lists by kind: domains, roles, tools and collections."""
    rows = [("domain", d) for d in (*ACTIVE, *PLANNED)] + [("role", r) for r in ROLES] + [("tool", t) for t in TOOLS] + [("collection", c) for c in COLLECTIONS]
    return spark.createDataFrame(rows, "kind string, name string")
