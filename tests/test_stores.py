"""Stored postings and vector lists: same results as without them, batches twice without effect, shelves pruned, recall."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafmill.functions import measures, texts
from sheafmill.operators import retrieval, stores
from sheafmill.plans import adapters as A
from sheafmill.plans import retrieval as plans
from sheafmill.sources import shared

SF = "/root/testdata/sf0.001"
ROWS = [(1, "The cat sat on the mat"), (2, "the dog\tTHE end"), (3, None), (4, ""), (5, "cat cat cat"), (6, "x " * 5000 + "cat")]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, content string")


def found(postings, *terms):
    wanted = postings.spark.createDataFrame([(t,) for t in terms], "term string")
    return sorted((r.term, r.id, r.pos) for r in postings.positions(wanted).collect())


def test_postings(spark):
    path = shared.fresh_path(spark, "test-postings")
    postings = stores.Postings(spark, path, 8)
    assert found(postings, "cat") == []
    postings.add(rows_of(spark, ROWS[:3]), "one")
    postings.add(rows_of(spark, ROWS[3:]), "two")
    again = stores.Postings(spark, path, 99)  # opened: it keeps its shelves
    assert again.shelves == 8
    want = [("cat", 1, 1), ("cat", 5, 0), ("cat", 5, 1), ("cat", 5, 2), ("cat", 6, 5000), ("the", 1, 0), ("the", 1, 4), ("the", 2, 0), ("the", 2, 2)]
    assert found(again, "cat", "the", "missing") == want
    again.add(rows_of(spark, ROWS[3:]), "two")  # twice without effect
    assert found(again, "cat", "the") == want
    counts = lambda: {r.term: r.n_docs for r in again.document_counts(spark.createDataFrame([("cat",), ("the",), ("no",)], "term string")).collect()}
    assert counts() == {"cat": 3, "the": 2}
    again.add(rows_of(spark, [(6, "now without")]), "two")  # another content of the batch replaces it
    assert found(again, "cat") == [("cat", 1, 1)] and counts() == {"cat": 1, "the": 2}
    with pytest.raises(ValueError):
        again.add(rows_of(spark, ROWS), "no/name")


def test_postings_read_their_shelves_alone(spark):
    postings = stores.Postings(spark, shared.fresh_path(spark, "test-postings"), 16)
    postings.add(A.chunks(spark, SF), "all")
    plan = postings.positions(spark.createDataFrame([("the",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shelf", plan) and "content" not in plan


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_once(spark):
    """Neither the postings nor the positions of terms ask for a text's tokens more than once, nor do the queries' terms; and postings are made without a shuffle."""
    rows, q = A.chunks(spark, SF).select("id", "content"), plans.query_set(spark, SF)
    tokens = rows.select("id", texts.lexemes(F.col("content")).alias("tokens"))
    made = stores.postings_of(tokens)
    assert "groupBy" not in plan_of(made) and "Aggregate" not in plan_of(made)
    terms = spark.createDataFrame([("the",)], "term string")
    for df in (made, retrieval.positions(rows, terms), texts.once_exploded(q, "pos", "term", F.col("terms"), "query_id")):
        assert plan_of(df).count("split(") == 1


def test_postings_of_odd_texts(spark):
    """Texts that are null, empty, blank, of one word, of the same words in another order, and without an id."""
    rows = [*ROWS, (7, " \t\n"), (8, "end THE dog"), (None, "lost cat"), (-9, "cat")]
    want = [(w, i, [p for p, x in enumerate(t.lower().split()) if x == w]) for i, t in rows if t for w in set(t.lower().split())]
    tokens = rows_of(spark, rows).coalesce(1).select("id", texts.lexemes(F.col("content")).alias("tokens"))
    order = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted((tuple(r) for r in stores.postings_of(tokens).collect()), key=order) == sorted(want, key=order)
    assert stores.postings_of(tokens.where("id IN (3, 4, 7)")).count() == 0


def test_frequent_terms_are_few_rows(spark):
    """A term that all texts of a task have is one stored row there, and is read and counted as before; ids that are missing stay so."""
    rows = spark.range(3000).select("id", F.concat(F.lit("The end the "), F.col("id").cast("string")).alias("content")).unionByName(rows_of(spark, [(None, "the lost")])).coalesce(2)
    postings = stores.Postings(spark, shared.fresh_path(spark, "test-postings"), 4)
    postings.add(rows, "one")
    assert spark.read.parquet(f"{postings.path}/blocks").where("term = 'the'").count() <= 3
    the = [(r.term, r.id, r.pos) for r in postings.positions(spark.createDataFrame([("end",), ("the",)], "term string")).collect()]
    assert len(the) == 3 * 3000 + 1 and set(the) == {(t, i, p) for i in range(3000) for t, p in (("the", 0), ("end", 1), ("the", 2))} | {("the", None, 0)}
    assert {r.term: r.n_docs for r in postings.document_counts(spark.createDataFrame([("the",), ("lost",)], "term string")).collect()} == {"the": 3001, "lost": 1}
    old = shared.fresh_path(spark, "test-postings")
    spark.range(1).write.parquet(f"{old}/postings")
    with pytest.raises(ValueError):
        stores.Postings(spark, old)


def test_lexical_search_by_postings(spark):
    rows, q = A.chunks(spark, SF), shared.written(plans.query_set(spark, SF), "test-queries")
    live = rows.where("review <> 'rejected'")
    postings = plans.stored_postings(spark, rows)
    for match in ("all", "any"):
        plain, stored = (sorted(map(tuple, retrieval.lexical(q, live, 10, match, p).collect())) for p in (None, postings))
        assert plain == stored and plain


def clustered(spark, n, dims=16, seed=1, first=0):
    random = np.random.default_rng(seed)
    centers = random.normal(size=(12, dims))
    rows = [(first + i, [float(x) for x in centers[i % 12] + 0.4 * random.normal(size=dims)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def test_vector_index(spark):
    rows, more = clustered(spark, 900), clustered(spark, 300, seed=1, first=2000).union(spark.createDataFrame([(5000, None), (5001, [0.0] * 16)], "id long, embedding array<float>"))
    path = shared.fresh_path(spark, "test-vectors")
    stores.VectorIndex.build(rows, path, "one").add(more, "two")
    index = stores.VectorIndex(spark, path)  # opened
    assert index.codes().count() == 1200 and index.settings["lists_probed"] < index.lists().count()
    whole = rows.union(more)
    q = whole.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact, got = retrieval.dense(q, whole, 10), index.search(q, whole, 10)
    want, have = pairs(exact), pairs(got)
    assert len(want & have) / len(want) >= 0.9
    distances = {(r.query_id, r.id): r.distance for r in exact.collect()}
    assert all(abs(distances[r.query_id, r.id] - r.distance) <= 1e-6 for r in got.collect() if (r.query_id, r.id) in distances)
    index.add(more, "two")
    assert index.codes().count() == 1200 and pairs(index.search(q, whole, 10)) == have
    gone = whole.where("id % 3 <> 0")  # rows that are no longer there, or not live, aren't found
    assert all(i % 3 for _, i in pairs(index.search(q, gone, 10)))


def test_nearest_in_lists_by_brute_force(monkeypatch):
    """A shelf's lists together: of the rows in the lists that a query probes, its k nearest by code, also where these are fewer, some queries at a time."""
    import pandas as pd

    draw = np.random.default_rng(6)
    monkeypatch.setattr(stores, "MET", 500)
    codes, scales = stores.coded(retrieval.unit(pd.Series(list(draw.normal(size=(90, 8))))))
    right = pd.DataFrame({"id": draw.permutation(90), "list": draw.integers(0, 7, 90) * 3, "code": [c.tobytes() for c in codes], "scale": scales})
    left = pd.DataFrame({"query_id": np.arange(20), "lists": [list(draw.choice([0, 3, 6, 9, 12, 15, 18, 99], n, replace=False)) for n in draw.integers(1, 6, 20)], "embedding": list(draw.normal(size=(20, 8)))})
    apart = np.round(1 - retrieval.unit(left["embedding"]) @ retrieval.unit(pd.Series(list(stores.decoded(right["code"], right["scale"])))).T, retrieval.DIGITS) + 0.0
    for k in (1, 9, 200):
        want = [(q, i, d) for q in range(20) for d, i in sorted((d, i) for d, i, on in zip(apart[q], right["id"], right["list"]) if on in left["lists"][q])[:k]]
        assert [tuple(r) for r in stores.nearest_in_lists(left, right, k).itertuples(index=False)] == want


def test_lists_of_a_shelf_give_k_rows_a_query(spark):
    """Candidates are merged by shelf before they are shuffled: the number of lists doesn't multiply them."""
    rows = clustered(spark, 900)
    index = stores.VectorIndex.build(rows, shared.fresh_path(spark, "test-vectors"), "one")
    index.settings = {"shelves_probed": 1, "lists_probed": 1 << 30}
    q = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    plan = index.candidates(q, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"FlatMapCoGroupsInPandas \[shelf#\d+, qb#\d+, rb#\d+\]", plan)
    assert index.candidates(q, 5).count() == 45 * 5


def test_distances_of_pairs(spark):
    """As `measures.cosine_distance`, over pairs of one and of other lengths, and null where it is undefined."""
    said = [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], []), ([3.0], [-2.0]), ([1.0, 5.0], [1.0, 5.0])]
    rows = spark.createDataFrame(said, "a array<float>, b array<float>").coalesce(1).select(stores.cosine_apart("a", "b").alias("x"), measures.cosine_distance(F.col("a"), F.col("b")).alias("y")).collect()
    assert [None if r.y is None else round(r.y, 12) for r in rows] == [None if r.x is None else round(r.x, 12) for r in rows] and rows[5].x == 2


def test_vector_search_reads_probed_shelves_alone(spark):
    rows, path = clustered(spark, 900), shared.fresh_path(spark, "test-vectors")
    index = stores.VectorIndex.build(rows, path, "one")
    index.settings = {"shelves_probed": 1, "lists_probed": 1}
    plan = index.candidates(rows.where("id = 7").select(F.col("id").alias("query_id"), "embedding"), 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shelf", plan)


def test_lists_grow_with_the_root_of_the_rows(spark):
    sizes = [stores.VectorIndex.build(clustered(spark, n), shared.fresh_path(spark, "test-vectors"), "one").lists().count() for n in (100, 1600)]
    assert 8 <= sizes[0] <= 16 and 30 <= sizes[1] <= 60


def test_index_of_equal_vectors(spark):
    """A third of all rows, and more, on one shelf and in one list."""
    same = spark.range(600).select("id", F.array(*[F.lit(float(i % 3)).cast("float") for i in range(16)]).alias("embedding"))
    rows = same.union(clustered(spark, 300, first=1000))
    index = stores.VectorIndex.build(rows, shared.fresh_path(spark, "test-vectors"), "one")
    hits = index.search(rows.where("id = 5").select(F.col("id").alias("query_id"), "embedding"), rows, 10).collect()
    assert len(hits) == 10 and all(r.distance == 0 for r in hits)


def test_no_vectors(spark):
    with pytest.raises(ValueError):
        stores.VectorIndex.build(clustered(spark, 3).where("false"), shared.fresh_path(spark, "test-vectors"), "one")
    with pytest.raises(ValueError):
        stores.VectorIndex(spark, shared.fresh_path(spark, "nowhere"))


def test_stored_recall(spark):
    """On the whole table of a larger scale."""
    exact, got = (pairs(q(spark, "/root/testdata/sf0.1")) for q in (plans.dense_topk_batch, plans.dense_stored_search))
    assert len(exact & got) / len(exact) >= 0.9


def test_stored_hybrid(spark):
    exact, got = (pairs(q(spark, SF)) for q in (plans.hybrid_rrf_search, plans.hybrid_stored_search))
    assert len(exact & got) / len(exact) >= 0.9


def test_lexical_search_by_brute_force(spark):
    """Queries of one to four terms of every frequency, repeated and unknown ones, over ties, empty rows and heavy rows: what is met by few terms is counted whole."""
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    odds = 1 / np.arange(1, 31) ** 1.3
    rows = [(i, " ".join(random.choice(words, size=int(random.integers(0, 40)), p=odds / odds.sum()))) for i in range(300)] + [(1000, None), (1001, "w0 " * 90), (1002, "w29 w0 w29")]
    queries = [(q, [str(t) for t in random.choice([*words, "none"], size=int(random.integers(1, 5)))]) for q in range(120)] + [(500, []), (501, ["w0"]), (502, ["w0", "w1"]), (503, ["w28", "w29"])]
    said = {i: (t or "").split() for i, t in rows}
    asked, held = spark.createDataFrame(queries, "query_id long, terms array<string>"), spark.createDataFrame(rows, "id long, content string")
    for k in (1, 4, 25):
        want = set()
        for q, terms in queries:
            hits = sorted((-sum(t in set(terms) for t in ts), i) for i, ts in said.items())
            want |= {(q, i, round(-0.1 * n, 6), r + 1) for r, (n, i) in enumerate(hits[:k]) if n}
        assert {tuple(r) for r in retrieval.lexical(asked, held, k, "any").select("query_id", "id", "density", "rank").collect()} == want
    all_ = {(r.query_id, r.id) for r in retrieval.lexical(asked, held, 1000).collect()}
    assert all_ == {(q, i) for q, terms in queries for i, ts in said.items() if terms and set(terms) <= set(ts)}


def test_few_rows_are_met(spark):
    """Rows that hold frequent terms once aren't met, since they can't come in: the number of (query, row) that are is a tenth of all hits."""
    rows = spark.range(400).select("id", F.when(F.col("id") < 40, F.repeat(F.lit("a b c "), 5)).otherwise(F.lit("a b c d")).alias("content"))
    q = spark.range(50).select(F.col("id").alias("query_id"), F.array(*map(F.lit, "abc")).alias("terms"))
    terms = q.select("query_id", F.explode("terms").alias("term"))
    counts = retrieval.positions(rows, terms.select("term").distinct()).groupBy("term", "id").agg(F.count("*").alias("tf"))
    least = retrieval.least_counts(terms, counts, q.select("query_id", F.lit(5).alias("floor")))
    assert counts.join(least, "term").where("tf >= least").count() == 50 * 120
    assert [r.id for r in retrieval.lexical(q.where("query_id = 7"), rows, 5, "any").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_nearest_in_block_with_ties(spark):
    """Equal distances go by id, also across the k-th place; rows without a direction are none's neighbours."""
    import pandas as pd

    draw = np.random.default_rng(4)
    vectors = draw.integers(-1, 2, (60, 3)).astype(float)  # many are equal, some are zero
    ids = draw.permutation(60)
    left, right = (pd.DataFrame({key: i, "embedding": list(v)}) for key, i, v in (("query_id", np.arange(20), vectors[:20]), ("id", ids, vectors)))
    with np.errstate(invalid="ignore"):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    apart = np.round(1 - unit[:20] @ unit.T, retrieval.DIGITS) + 0.0
    for k in (1, 7, 59, 60, 100):
        want = [(q, i, d) for q in range(20) for d, i in sorted((d, i) for d, i in zip(apart[q], ids) if not np.isnan(d))[:k]]
        assert [tuple(r) for r in retrieval.nearest_in_block(left, right, k).itertuples(index=False)] == want


def test_searches_read_texts_apart(spark):
    """Texts aren't joined with vectors for searches, conditions on a query set's terms aren't tried on texts, and hits are broadcast to their contents."""
    assert "split(" not in plan_of(plans.asked(spark, SF).where("size(terms) > 0"))
    plan = plan_of(plans.hybrid_rrf_search(spark, SF))
    assert plan.count("Join") == 2 and "vec_id" not in plan and "strategy=broadcast" in plan


def test_lexemes_of_whole_texts(spark):
    """Lower-cased as a whole a text has the lower-cased tokens, also where a letter's form depends on its neighbours; blanks at the ends are no tokens."""
    said = ["ΟΔΟΣ ΣΑΣ Σ", "İstanbul İ", " A\u0085ΣΑΣ Σ. Σ'Α ", " \t\n", ""]
    rows = rows_of(spark, list(enumerate(said)))
    got = rows.select("id", texts.lexemes(F.col("content")).alias("a"), F.transform(texts.tokens(F.col("content")), F.lower).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    every = spark.createDataFrame([(w,) for r in got for w in {*r.b, ""}], "term string").distinct()
    placed = retrieval.positions(rows, every).collect()
    for r in got:
        assert [x.term for x in sorted((x for x in placed if x.id == r.id), key=lambda x: x.pos)] == r.b
