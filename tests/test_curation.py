"""Curation, lifecycle, export and queue cases that the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from sheafmill.operators import assist, curation, export, ingest, lifecycle
from sheafmill.streaming import queue


def test_spell_check(spark):
    words = spark.createDataFrame([("hte",), ("the",), ("qqqq",), ("ab",)], "word string")
    known = spark.createDataFrame([("the",), ("hat",), ("he",), ("abc",), ("cab",), ("b",), ("bb",), ("ax",), ("ba",)], "word string")
    got = {r.word: (r.in_dictionary, r.suggestions) for r in curation.spell_checked(words, known, "abcdefghijklmnopqrstuvwxyz").collect()}
    assert got == {"hte": (False, ["he", "the"]), "the": (True, []), "qqqq": (False, []), "ab": (False, ["abc", "ax", "b", "ba", "bb"])}


def test_spell_check_of_words_of_any_length(spark, tmp_path):
    from sheafmill.plans import texts

    said, known = "I a onn understandingg internationalisatio the 12", "a on one understanding internationalisation"
    spark.createDataFrame([(1, said)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, "user", known)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    letters = "abcdefghijklmnopqrstuvwxyz"

    def one_off(w):
        parts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1:] for a, b in parts if b} | {a + b[1] + b[0] + b[2:] for a, b in parts if len(b) > 1} | {a + c + b[1:] for a, b in parts if b for c in letters} | {a + c + b for a, b in parts for c in letters}

    entries = set(known.split())
    words = {w for w in said.lower().split() if w.isalpha()}
    want = {(w, w in entries, ",".join([] if w in entries else sorted(one_off(w) & entries)[:5])) for w in words}
    assert {tuple(r) for r in texts.spellcheck(spark, str(tmp_path)).collect()} == want


def test_account_tables(spark):
    lao = "ເງິນສົດ"
    good = [["Code", "Name", "English"], ["101", lao, "Cash"], ["102", lao, "Bank"], ["sum", "", ""]]
    tie = [["101", lao, "201"], ["102", lao, "202"]]
    rows = spark.createDataFrame([(1, good), (2, [["101", lao]] * 3), (3, tie), (4, [["x", "y", "z"]] * 3)], "table_id long, cells array<array<string>>")
    got = {r.table_id: r for r in curation.account_tables(rows).collect()}
    assert not got[1].is_coa and got[1].confidence == pytest.approx(2 / 3)  # two of three codes are under 0.8
    assert (got[2].is_coa, got[4].is_coa) == (False, False)
    assert (got[3].is_coa, got[3].code_col, got[3].lao_col, [x.code for x in got[3].rows]) == (True, 2, 1, ["201", "202"])
    wide = [["Code", "Name", "English"], *[[f" {k} ", lao, "" if k == 103 else "Cash"] for k in range(101, 106)], ["total", "", ""]]
    ragged = spark.createDataFrame([(5, wide), (6, [["101"], ["102", lao, "x"], ["103", lao]]), (7, []), (8, [[], []])], "table_id long, cells array<array<string>>")
    got = {r.table_id: r for r in curation.account_tables(ragged).collect()}
    assert (got[5].is_coa, got[5].confidence, got[5].code_col, got[5].lao_col, got[5].en_col) == (True, 0.833, 0, 1, 2)
    assert [tuple(x) for x in got[5].rows] == [(str(k), lao, None if k == 103 else "Cash") for k in range(101, 106)]
    assert [tuple(x) for x in got[6].rows] == [("102", lao, "x"), ("103", lao, None)]
    assert (got[7].is_coa, got[8].is_coa, got[7].confidence) == (False, False, 0.0)


def test_citations(spark):
    chunks = spark.createDataFrame([(1, "accepted"), (2, "rejected"), (3, "pending")], "id long, review string")
    qa = spark.createDataFrame([(1, [1, 3]), (2, []), (3, [1, 1]), (4, [1, 9]), (5, [2])], "qa_id long, citations array<long>")
    assert {r.qa_id: r.reason for r in curation.citation_problems(qa, chunks).collect()} == {2: "empty", 3: "missing", 4: "missing", 5: "rejected"}
    assert {r.qa_id for r in curation.all_citations_in(qa, chunks.where("review <> 'rejected'")).collect()} == {1, 3}


def test_insert_or_ignore(spark):
    base = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "k string, v int")
    assert {tuple(r) for r in lifecycle.insert_or_ignore(base, rows, ["k"], "v").collect()} == {("a", 1), ("b", 3)}


def test_windows_over_files_in_any_order_of_time(spark, tmp_path):
    import os

    from sheafmill.plans import streams

    dated = set()
    for i, days in enumerate([(30, 29), (1, 2, 30), (15, 1), (2,)]):
        rows = spark.sql(" UNION ALL ".join(f"SELECT {10 * i + d}L AS event_id, TIMESTAMP_NTZ '2024-01-{d:02} 12:00:00' AS ts, 1L AS user_id, 'view' AS event_type, 1.5D AS value, '' AS props" for d in days))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        for f in (tmp_path / "events.parquet").glob("part-*"):
            if f.name not in dated:
                dated.add(f.name)
                os.utime(f, (1e9 + i, 1e9 + i))
    for files in (1, 64):
        got = {(r.day.day, r.n, r.value) for r in streams.event_time_windows(spark, str(tmp_path), files).collect()}
        assert got == {(1, 2, 3.0), (2, 2, 3.0), (15, 1, 1.5), (29, 1, 1.5), (30, 2, 3.0)}


def test_patch(spark):
    base = spark.createDataFrame([(1, "x", True), (2, "y", True)], "id long, name string, verified boolean")
    patch = spark.createDataFrame([(1, "z"), (2, None)], "id long, name string")
    assert {tuple(r) for r in lifecycle.patched(base, patch, "id").collect()} == {(1, "z", False), (2, "y", True)}


def test_retro_clean(spark):
    from sheafmill.functions import texts

    rows = spark.createDataFrame([(1, "c", "a​b", [1.0]), (2, "c", "ok", [2.0])], "id long, collection string, content string, embedding array<float>")
    out, report, jobs = lifecycle.retro_cleaned(rows, texts.defect_counts(F.col("content"))["total"], texts.defects_fixed(F.col("content")))
    assert {(r.id, r.content, r.embedding is None) for r in out.collect()} == {(1, "ab", True), (2, "ok", False)}
    assert [tuple(r) for r in report.collect()] == [("c", 1, 1)] and [r.id for r in jobs.collect()] == [1]


def test_export(spark, tmp_path):
    with pytest.raises(ValueError):
        export.checked_version("1.0")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string")
    lines = export.lines(rows, ["id", "text"])
    export.write(lines, str(tmp_path), "1.0.0")
    assert spark.read.text(f"{tmp_path}/1.0.0").count() == 5
    with pytest.raises(Exception, match="already exists"):
        export.write(lines, str(tmp_path), "1.0.0")
    assert export.manifest(lines).collect() == export.manifest(lines.repartition(3)).collect()
    versions = spark.createDataFrame([("f", "1.9.0"), ("f", "1.10.0")], "file string, version string")
    assert export.newest_version(versions).first().version == "1.10.0"


def test_ingest_twice_adds_nothing(spark):
    docs = spark.createDataFrame([(1, "c", "# H\n\ntext one"), (2, "c", "# H\n\ntext one"), (3, "d", "# H\n\ntext one")], "id long, collection string, content string")
    first = ingest.ingested(docs)
    assert {r.id for r in first.documents.collect()} == {1, 3}
    assert [(r.kind, r.content, r.path) for r in first.chunks.where("doc_id = 1").collect()] == [("prose", "text one", ["H"])]
    assert ingest.ingested(docs, first.documents).documents.count() == 0


def test_job_states(spark):
    rows = [(1, i, i, False) for i in range(1)] + [(2, i, i, i < 2) for i in range(3)] + [(3, i, i, True) for i in range(7)] + [(4, 0, 0, True)]
    got = {r.job_id: (r.failures, r.status, r.wait_seconds) for r in queue.job_states(spark.createDataFrame(rows, "job_id long, ts long, event_id long, failed boolean")).collect()}
    assert got == {1: (0, "done", None), 2: (2, "done", None), 3: (5, "dead", None), 4: (1, "pending", 10)}


def test_batches_come_twice(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    for _ in range(2):
        queue.once_by_id(batch, str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_frames(spark):
    body = 'event: x\ndata: {"a": "1"}\n\n: ping\n\ndata: {"a": "2"}\n\n'
    rows = queue.frames(spark.createDataFrame([(1, body)], "stream_id long, body string")).orderBy("n").collect()
    assert [(r.n, r.event) for r in rows] == [(0, {"a": "1"}), (2, {"a": "2"})]


def test_assist(spark):
    q = spark.createDataFrame([("Outstanding for INV-7?",), ("trial  balance",), ("hello",)], "text string")
    got = [[(x.tool, x.argument) for x in r.x] for r in q.select(assist.intents(F.col("text")).alias("x")).collect()]
    assert got == [[("outstanding", None), ("invoice_lookup", "INV-7?")], [("trial_balance", None)], []]
    answers = spark.createDataFrame([('{"score": 9, "reason": "r"}',), ("nonsense",)], "a string")
    assert [(r.x.score, r.x.reason) for r in answers.select(assist.judged(F.col("a")).alias("x")).collect()] == [(5, "r"), (1, "nonsense")]
    sources = spark.createDataFrame([(1, 2, "web", ["p"], "y" * 2000), (1, 1, "dataset", ["a", "b"], "x" * 900)], "query_id long, n long, origin string, path array<string>, content string")
    assert assist.context_blocks(sources).first().context == "[1] a › b\n" + "x" * 700 + "\n\n[2] p\n" + "y" * 1600
    named = assist.customers_named(spark.createDataFrame([(1, "what does ABC owe")], "query_id long, text string"), spark.createDataFrame([(1, "ບໍລິສັດ ABC ຈຳກັດ"), (2, "XYZ")], "customer_id long, customer string"))
    assert [tuple(r) for r in named.collect()] == [(1, "ບໍລິສັດ ABC ຈຳກັດ")]


def brute_density(tokens, terms):
    """Shortest stretches that hold all terms, by trying all."""
    at = [i for i, t in enumerate(tokens) if t in terms]
    holds = [(a, b) for a in at for b in at if a <= b and set(terms) <= set(tokens[a : b + 1])]
    shortest = [(a, b) for a, b in holds if not any((c, d) != (a, b) and a <= c and d <= b for c, d in holds)]
    return sum(0.1 / (1 + sum(t not in terms for t in tokens[a : b + 1])) for a, b in shortest)


def test_cover_density(spark):
    import random

    from sheafmill.operators import retrieval

    random.seed(4)
    rows = [(i, " ".join(random.choice("abcxyz") for _ in range(random.randint(0, 25)))) for i in range(60)]
    asked = [(1, ["a"]), (2, ["a", "b"]), (3, ["c", "a", "b"]), (4, ["a", "a"])]
    got = retrieval.lexical(spark.createDataFrame(asked, "query_id long, terms array<string>"), spark.createDataFrame(rows, "id long, content string"), 100).collect()
    want = {(q, i): round(d, 6) for q, terms in asked for i, text in rows if (d := brute_density(text.split(), set(terms)))}
    assert {(r.query_id, r.id): r.density for r in got} == want
    assert retrieval.lexical(spark.createDataFrame(asked, "query_id long, terms array<string>"), spark.createDataFrame([], "id long, content string"), 5).count() == 0


def test_expanded_queries(spark):
    from sheafmill.operators import retrieval

    asked = spark.createDataFrame([(1, ["bluebird", "x"]), (2, ["y"])], "query_id long, terms array<string>")
    terms = spark.createDataFrame([("Blue",), ("bird x",), ("red",)], "term string")
    assert {r.query_id: r.terms for r in retrieval.expanded(asked, terms).collect()} == {1: ["bluebird", "x", "bird x", "blue"], 2: ["y"]}


def test_numbers_and_percentiles_of_groups_over_many_partitions(spark):
    import math

    from sheafmill.operators import ordering

    rows = [("hot", float(i % 97), i) for i in range(1500)] + [(None, 1.0, 5), ("one", 3.0, 9), ("gap", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, o long").repartition(5)
    got = {(r.k, r.o): r.n for r in ordering.numbered(df, ["k"], ["o"]).collect()}
    assert got == {("hot", i): i + 1 for i in range(1500)} | {(None, 5): 1, ("one", 9): 1, ("gap", 1): 1}
    ordered = sorted(v for k, v, _ in rows if k == "hot")
    found = {r.k: (r.p50, r.p99) for r in ordering.percentiles(df, "k", "v", (50, 99)).collect()}
    assert found["hot"] == tuple(ordered[min(1499, math.floor(p / 100 * 1500))] for p in (50, 99)) and found["one"] == (3.0, 3.0) and "gap" not in found


def test_kinds_deleted(spark):
    documents = spark.createDataFrame([("d1", "a"), ("d2", "a"), ("d3", "b"), ("d4", "c")], "document string, kind string")
    chunks = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d3"), (4, "d3")], "id long, document string")
    qa = spark.createDataFrame([(1, [1, 2]), (2, [1])], "qa_id long, citations array<long>")
    kinds = spark.createDataFrame([("a",), ("b",), ("c",), ("zzz",)], "kind string")
    for force, left in ((False, {"d1", "d2"}), (True, set())):
        docs_left, chunks_left, report, events = lifecycle.kinds_deleted(documents, chunks, qa, kinds, F.lit("t"), force)
        assert {r.document for r in docs_left.collect()} == left and {r.document for r in chunks_left.collect()} == left
        assert {r.kind: (r.documents, r.chunks, r.cited_qa, r.distinct_qa, r.blocked) for r in report.collect()} == {"a": (2, 2, 3, 2, not force), "b": (1, 2, 0, 0, False), "c": (1, 0, 0, 0, False)}
        assert events.count() == (3 if force else 2)


def test_edits_are_segmented_anew(spark):
    rows = spark.createDataFrame([(1, "old", "old", 1, "en", "pending", [1.0]), (2, "x", "x", 1, "en", "pending", [1.0])], "id long, content string, content_norm string, token_count int, lang string, review string, embedding array<float>")
    actions = spark.createDataFrame([(1, "edit", " ບັນຊີ  ກ "), (2, "edit", "  ")], "id long, action string, content string")
    out, jobs = lifecycle.reviewed(rows, actions)
    got = {r.id: r for r in out.collect()}
    assert (got[1].content_norm, got[1].token_count, got[1].lang, got[1].review, got[1].embedding) == ("ບັນຊີ ກ", 2, "lo", "edited", None)
    assert (got[2].content, got[2].review) == ("x", "pending") and [r.id for r in jobs.collect()] == [1]


def test_claims(spark):
    rows = [(1, "pending", 5, 0, 5, None), (2, "running", 3, 1, 5, 1), (3, "done", 1, 0, 5, None), (4, "pending", 2, 5, 5, None), (5, "pending", 99, 0, 5, None), (6, "pending", 3, 0, 5, None)]
    jobs = spark.createDataFrame(rows, "job_id long, status string, run_after long, attempts int, max_attempts int, locked_at long")
    after, taken = queue.claimed(jobs, F.lit(10).cast("long"), 2)
    assert [r.job_id for r in queue.runnable(jobs, F.lit(10), 9).collect()] == [2, 6, 1]
    assert {r.job_id for r in taken.collect()} == {2, 6}
    assert {r.job_id: (r.status, r.locked_at) for r in after.collect()} == {1: ("pending", None), 2: ("running", 10), 3: ("done", None), 4: ("pending", None), 5: ("pending", None), 6: ("running", 10)}


def test_batched_map(spark):
    made = queue.mapped_in_batches(spark.range(100).repartition(3), lambda xs: [len(xs)] * len(xs), "id", "n", "long", 8).collect()
    assert {r.id for r in made} == set(range(100)) and max(r.n for r in made) == 8


def test_agent_requests(spark):
    asked = [(1, "accounting", "bookkeeper", "what of 41011 and 4102 in blue"), (2, "payroll", "bookkeeper", ""), (3, "law", "bookkeeper", ""), (4, "accounting", "guest", ""), (5, None, "auditor", ""), (6, "accounting", None, "")]
    q = spark.createDataFrame(asked, "query_id long, domain string, role string, text string")
    assert {r.query_id: r.s for r in q.select("query_id", assist.request_status(F.col("domain"), F.col("role")).alias("s")).collect()} == {1: 200, 2: 409, 3: 404, 4: 404, 5: 404, 6: 404}
    chart = spark.createDataFrame([("410110",), ("41011",), ("410",), ("4102",)], "code string")
    found = assist.tool_calls(q.where("query_id = 1"), chart, spark.createDataFrame([("Blue",), ("red",)], "term string")).collect()
    assert {(r.tool, r.input, tuple(r.found)) for r in found} == {("coa_search", "41011", ("41011", "410110")), ("coa_search", "4102", ("4102",)), ("glossary_lookup", asked[0][3], ("Blue",))}


def test_parsed_answers(spark):
    answers = ['{"question": "q", "answer": "a"}', '{"question": "q"}', "no json", None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "id int, a string").select("id", assist.parsed(F.col("a"), "question string, answer string", answer="-").alias("x")).orderBy("id").collect()
    assert [tuple(r.x) for r in rows] == [("q", "a", None), ("q", "-", None), (None, "-", "no json"), (None, "-", None)]


def test_vectors_objects_and_messages(spark):
    from sheafmill.operators import filters, model

    chunks = spark.createDataFrame([(1, "a", None), (2, "a", [1.0]), (3, "b", None)], "id long, collection string, embedding array<float>")
    out, status = lifecycle.with_vectors(chunks, spark.createDataFrame([(1, [2.0]), (2, [9.0])], "id long, vector array<float>"))
    assert {r.id: r.embedding for r in out.collect()} == {1: [2.0], 2: [1.0], 3: None} and {r.collection: r.status for r in status.collect()} == {"a": "embedded", "b": "chunked"}
    base = spark.createDataFrame([("k1", "old")], "key string, content string")
    assert {tuple(r) for r in lifecycle.put(base, spark.createDataFrame([("k1", "new"), ("k2", "x"), ("k2", "x")], "key string, content string")).collect()} == {("k1", "old"), ("k2", "x")}
    threads = spark.sql("SELECT 'a' AS id, TIMESTAMP '2024-01-01' AS updated_at")
    said = spark.sql("SELECT 'a' AS conversation_id, 'user' AS role, TIMESTAMP '2024-01-03' AS created_at")
    after, messages, events = model.messages_added(threads, said.limit(0), said)
    assert (str(after.first().updated_at)[:10], messages.count(), events.first().event_type) == ("2024-01-03", 1, "message.created")
    asked = spark.createDataFrame([("x", 5), ("", 51), ("x", None)], "q string, k int")
    assert [r.p for r in asked.select(filters.request_problems(F.col("q"), F.col("k")).alias("p")).collect()] == [[], ["query", "k"], []]


def test_account_names(spark):
    rows = spark.createDataFrame([("411 Cash — x", "411"), ("Bank", "411"), ("4112", "411")], "c string, code string")
    assert [r.n for r in rows.select(curation.account_name(F.col("c"), F.col("code")).alias("n")).collect()] == ["Cash", "Bank", "2"]


def test_prompts_with_a_system_part(spark):
    q = spark.createDataFrame([(1, "q?"), (2, "r?")], "query_id long, text string")
    none = lambda c: spark.createDataFrame([], f"query_id long, {c} string")
    made = assist.prompts(q, none("context"), none("history"), none("terms"), spark.createDataFrame([(1, "be brief")], "query_id long, system string"))
    assert {r.query_id: r.prompt for r in made.collect()} == {1: "System\nbe brief\n\nQuestion\nq?", 2: "Question\nr?"}


def test_chat_turn(spark):
    """Sources of the search come first, then the ledger's for each invoice that is named, numbered on; a question without any has none."""
    questions = spark.createDataFrame([(1, "what about inv-7 and INV-8, inv-7?"), (2, "nothing"), (3, None)], "query_id long, text string")
    messages = spark.createDataFrame([(1, 1, "user", "before")], "conv_id long, place long, role string, text string")
    hits = spark.createDataFrame([(1, 50, 2, ["b"], "second"), (1, 60, 1, ["a"], "x" * 900)], "query_id long, id long, rank long, path array<string>, content string")
    ledger = spark.createDataFrame([("INV-7", "INV-7 paid"), ("INV-9", "other")], "ref string, content string")
    terms = spark.createDataFrame([(2, "blue")], "query_id long, terms string")
    turn = assist.chat_turns(questions, messages, hits, ledger, terms)
    assert [(r.n, r.origin, r.id) for r in turn.sources.orderBy("n").collect()] == [(1, "dataset", "60"), (2, "dataset", "50"), (3, "erp", "INV-7")]
    made = {r.query_id: r.prompt for r in turn.prompts.collect()}
    assert made[1] == "History\nuser: before\n\nSources\n[1] a\n" + "x" * 700 + "\n\n[2] b\nsecond\n\n[3] ledger\nINV-7 paid\n\nQuestion\nwhat about inv-7 and INV-8, inv-7?"
    assert made[2] == "Terms\nblue\n\nQuestion\nnothing" and made[3] == ""


@pytest.mark.parametrize(("fullest", "most", "least"), [(4096, 5, 2), (1, 5, 2), (1, 1000, 1), (2, 0, 2)])
def test_mined_terms_are_all_counted(spark, monkeypatch, fullest, most, least):
    """Whatever number of buckets is counted exactly at first, the result is that of counting all runs."""
    import random
    from collections import Counter

    monkeypatch.setattr(curation, "FULLEST", fullest)
    draw = random.Random(3)
    words = ["a", "bb", "cc", "ccc", "bbc", "c", "ນນ", "\U0001f600\U0001f600", *(f"w{i}" for i in range(40))]
    said = [None, "", " \t", "bb", *(" ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=draw.randrange(30))) for _ in range(60))]
    runs = Counter()
    for text in said:
        found = (text or "").split()
        runs.update(" ".join(found[i : i + n]) for n in (2, 3) for i in range(len(found) - n + 1) if min(map(len, found[i : i + n])) > 1)
    top = sorted(((r.replace(" ", ""), r, n) for r, n in runs.items() if n >= least and r.replace(" ", "") not in ("bbcc", "ccccc")), key=lambda x: (-x[2], x[1].encode()))[:most]
    rows = spark.createDataFrame(list(enumerate(said)), "id long, content string").repartition(3)
    got = curation.mined_terms(rows, spark.createDataFrame([("bbcc",), ("ccccc",)], "term string"), min_freq=least, most=most)
    assert [tuple(r) for r in got.collect()] == top


def test_mined_terms_pass_rare_runs_over():
    """Of runs that stand once each, hardly any shares a bucket with the frequent ones, and only those are told apart."""
    import numpy as np
    import pyarrow as pa

    rare = [f"r{i}" for i in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([["hot", "pair"]] * 50 + [rare] + [None, []], pa.list_(pa.string()))], names=["toks"])
    (counts,) = curation.bucket_counts(iter([batch]))
    full = dict(zip(*(c.to_pylist() for c in counts.columns), strict=True))
    assert sum(full.values()) == 50 + 19_999 + 19_998
    told = pa.Table.from_batches(curation.run_counts(iter([batch]), np.array([full.get(b, 0) >= 50 for b in range(curation.BUCKETS)]))).to_pylist()
    assert {"term_seg": "hot pair", "n": 50} in told and len(told) < 10


def test_contents_are_chunks_without_vectors(spark, tmp_path):
    """A text has as many rows as with vectors, also where several vectors have its id, and meets none of the others."""
    from sheafmill.plans import adapters

    spark.createDataFrame([(i, f"text {i}", "en", f"source-{i}", 6) for i in range(5)] + [(None, "unnamed", "en", None, 7)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, ids in (("repeated", [0, 1, 1, 1, None, None, 9]), ("once", [0, 1, 9])):
        sf_dir = tmp_path / name
        sf_dir.mkdir()
        for table in ("documents", "labels"):
            (sf_dir / f"{table}.parquet").symlink_to(tmp_path / f"{table}.parquet")
        spark.createDataFrame([(i, [1.0]) for i in ids], "vec_id long, embedding array<float>").write.parquet(f"{sf_dir}/embeddings.parquet")
        found = adapters.contents(spark, str(sf_dir))
        assert sorted(map(str, found.collect())) == sorted(map(str, adapters.chunks(spark, str(sf_dir)).select(found.columns).collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
