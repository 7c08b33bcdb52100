"""Dense, lexical and fused retrieval for tables of queries, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafmill.functions import measures, texts
from sheafmill.sources import shared

if TYPE_CHECKING:
    from sheafmill.operators.stores import Postings, VectorIndex

QUERY_BLOCK, ROW_BLOCK = 2048, 4096
DIGITS = 6
#: Pairs of rows and lists that are ranked, or dealt, at a time: a batch of rows in all its lists may be a hundred times as large.
DEALT = 1 << 16
#: Terms of a query set (some 20 bytes each): broadcast up to so many, shuffled beyond.
BROADCAST_TERMS = 200_000
#: Fused hits (some 64 bytes each): broadcast to the rows with their contents up to so many.
BROADCAST_HITS = shared.BROADCAST_BYTES // 64
#: Counts of a term in a row that are told apart when low ones are passed over.
LEVELS = 64
#: What an occurrence without a class of its own weighs in cover density ranks (the default of text search in PostgreSQL).
TERM_WEIGHT = 0.1


def pool_size(k: int, floor: int = 100) -> int:
    """Candidates a list gives to the fusion."""
    return max(4 * k, floor)


def ranked(scored: DataFrame, order: list, k: int, by: str = "query_id") -> DataFrame:
    """The first k of each query with their ranks; the order must end in the id, so that there are no ties."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def dense_one(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, distance) of the k nearest rows to one vector: a sort with a limit, no shuffle of all rows."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    return rows.where("embedding IS NOT NULL").select("id", F.round(measures.cosine_distance(F.col("embedding"), vector), DIGITS).alias("distance")).orderBy("distance", "id").limit(k)


def dense(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): exact nearest rows by cosine. Blocks of queries meet blocks of rows as matrix products,
    each block pair gives k candidates a query, and a window merges them."""
    q = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    r = rows.where("embedding IS NOT NULL").select("id", "embedding")
    n_q, n_r = (-(-max(1, n) // b) for n, b in ((q.count(), QUERY_BLOCK), (r.count(), ROW_BLOCK)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    r = r.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(n_r)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    met = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(lambda left, right: nearest_in_block(left, right, k), "query_id long, id long, distance double")
    return ranked(met, ["distance", "id"], k)


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def nearest_in_block(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block to each query of a block."""
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": [], "id": [], "distance": []})
    return nearest_of(left["query_id"].to_numpy(), unit(left["embedding"]), right["id"].to_numpy(), unit(right["embedding"]), k)


def nearest_of(queries: np.ndarray, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, met: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest of some unit vectors to each of some others; of those that it meets, if these are marked."""
    apart = np.round(1.0 - asked @ vectors.T, DIGITS) + 0.0
    if met is not None:
        apart[~met] = np.inf
    places, lines = [], []
    for line in apart:
        # rows beyond the k-th distance needn't be sorted; those as far as it stay
        near = np.flatnonzero(np.isfinite(line))
        if len(near) > k:
            near = near[line[near] <= np.partition(line[near], k - 1)[k - 1]]
        places.append(near[np.lexsort((ids[near], line[near]))[:k]])
        lines.append(line[places[-1]])
    return pd.DataFrame({"query_id": np.repeat(queries, [len(x) for x in places]), "id": ids[np.concatenate(places)], "distance": np.concatenate(lines)})


def positions(rows: DataFrame, terms: DataFrame, text: str = "content") -> DataFrame:
    """(term, id, pos): where the wanted terms (term) stand among each row's lower-cased, blank-parted tokens, counted from any number on. All other tokens end here, and so does what is empty
    beside blanks at a text's ends, which is cheaper than taking it out of each list."""
    found = texts.once_exploded(rows, "pos", "term", F.split(F.lower(F.col(text)), texts.UNICODE_BLANKS), "id").where("term <> ''")
    return found.join(shared.small_or_shuffled(terms, BROADCAST_TERMS), "term", "left_semi")


def cover_density(entries: Column, n_terms: Column) -> Column:
    """The cover density rank of a row's entries (pos, term), in order of pos: each shortest stretch that holds all n terms counts
    `TERM_WEIGHT` over one more than the tokens in it that are no entries. Of one term, that is its frequency times the weight.
    A stretch that ends at an entry begins at the earliest of all terms' last entries; it is a shortest one if no earlier end has that beginning."""
    kinds = F.array_distinct(F.transform(entries, lambda e: e["term"]))
    begin = F.struct(F.transform(kinds, lambda t: F.lit(-1)).alias("last"), F.lit(-1).alias("from"), F.lit(0).alias("at"), F.lit(0.0).alias("rank"))

    def step(s: Column, e: Column) -> Column:
        last = F.transform(kinds, lambda t, i: F.when(t == e["term"], s["at"]).otherwise(F.get(s["last"], i)))

        def counted(last: Column) -> Column:
            low = F.array_min(last)
            between = (e["pos"] - F.get(entries, low)["pos"]) - (s["at"] - low)
            gain = F.when((low >= 0) & (low > s["from"]), F.lit(TERM_WEIGHT) / (1 + between)).otherwise(F.lit(0.0))
            return F.struct(last.alias("last"), F.greatest(low, s["from"]).alias("from"), (s["at"] + 1).alias("at"), (s["rank"] + gain).alias("rank"))

        return F.element_at(F.transform(F.array(last), counted), 1)

    return F.when(F.size(kinds) == n_terms, F.aggregate(entries, begin, step, lambda s: s["rank"])).otherwise(F.lit(0.0))


def lexical(queries: DataFrame, rows: DataFrame, k: int, match: str = "all", postings: Postings | None = None) -> DataFrame:
    """(query_id, id, density, rank): rows that hold all of a query's `terms`, by cover density; or, for "any", by the weight of all their
    occurrences. Terms are looked up in stored `postings`, if they are given, of which the rows' own count; else they are found in the rows' texts."""
    wanted = queries.select("query_id", F.array_distinct("terms").alias("terms"))
    wanted = shared.written(texts.once_exploded(wanted, "_pos", "term", F.col("terms"), "query_id", F.size("terms").alias("n_terms")).drop("_pos"), "lexical-terms")
    distinct = shared.written(wanted.select("term").distinct(), "lexical-distinct")
    found = positions(rows, distinct) if postings is None else postings.positions(distinct).join(rows.select("id"), "id", "left_semi")
    density = with_all(wanted, found) if match == "all" else with_any(wanted, found, k)
    return ranked(density.select("query_id", "id", F.round("density", DIGITS).alias("density")), [F.desc("density"), "id"], k)


def with_all(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, id, density) of the rows that hold all of a query's terms (query_id, n_terms, term): those of its rarest term are looked up for the others.
    What is found are (term, id, pos)."""
    held = shared.written(found.groupBy("term", "id").agg(F.sort_array(F.collect_list("pos")).alias("at")), "lexical-held")
    sizes = held.groupBy("term").agg(F.count("*").alias("df"))
    per = wanted.join(sizes, "term").groupBy("query_id", "n_terms").agg(F.count("*").alias("known"), F.min_by("term", F.struct("df", "term")).alias("term"))
    rarest = shared.written(per.where("known = n_terms").select("query_id", "n_terms", "term"), "lexical-rarest")
    met = shared.written(held.join(shared.small_or_shuffled(rarest, BROADCAST_TERMS), "term"), "lexical-met")  # (term, id, at, query_id, n_terms)
    others = shared.written(wanted.join(rarest.select("query_id", F.col("term").alias("rare")), "query_id").where("term <> rare").select("query_id", "term"), "lexical-others")
    looked = met.where("n_terms > 1").select("query_id", "n_terms", "id").join(shared.small_or_shuffled(others, BROADCAST_TERMS), "query_id").join(held, ["term", "id"])
    every = looked.groupBy("query_id", "id").agg(F.count("*").alias("n"), F.collect_list(F.struct("term", "at")).alias("more"))
    rows = met.join(every, ["query_id", "id"], "left").where("coalesce(n, 0) = n_terms - 1")
    lists = F.concat(F.array(F.struct("term", "at")), F.coalesce("more", F.array().cast("array<struct<term: string, at: array<int>>>")))
    entries = F.flatten(F.transform(lists, lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("pos"), x["term"].alias("term")))))
    rows = rows.select("query_id", "id", "n_terms", F.sort_array(entries).alias("entries"))
    return rows.select("query_id", "id", cover_density(F.col("entries"), F.col("n_terms")).alias("density"))


def with_any(wanted: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, density) of each query's first k rows at least, by how often they hold its terms (query_id, term), and of few others. A row that holds one of
    the terms alone is among that term's first k; so these are taken, and the k-th best of them is a floor. Of rows that hold several, those that can reach it are
    met by `least_counts`, and counted whole."""
    counts = shared.written(found.groupBy("term", "id").agg(F.count("*").alias("tf")), "lexical-counts")
    terms = wanted.select("query_id", "term")
    tops = shared.written(ranked(counts, [F.desc("tf"), "id"], k, "term").drop("rank"), "lexical-tops")
    alone = shared.written(terms.join(tops, "term").groupBy("query_id", "id").agg(F.max("tf").alias("tf")), "lexical-alone")
    floors = ranked(alone, [F.desc("tf"), "id"], k).where(F.col("rank") == k).select("query_id", F.col("tf").alias("floor"))
    least = shared.written(least_counts(terms, counts, floors), "lexical-least")
    met = counts.join(shared.small_or_shuffled(least, BROADCAST_TERMS), "term").where("tf >= least").select("query_id", "id").distinct()
    whole = shared.written(met, "lexical-met").join(shared.small_or_shuffled(wanted.select("query_id", "term"), BROADCAST_TERMS), "query_id").join(counts, ["term", "id"])
    both = alone.unionByName(whole.groupBy("query_id", "id").agg(F.sum("tf").alias("tf"))).groupBy("query_id", "id").agg(F.max("tf").alias("tf"))
    return both.select("query_id", "id", (TERM_WEIGHT * F.col("tf")).alias("density"))


def least_counts(terms: DataFrame, counts: DataFrame, floors: DataFrame) -> DataFrame:
    """(query_id, term, least): how often a row has to hold a term to be met by it, so that each row that holds several of a query's terms, at least its floor in all,
    is met by one. Of two ways the one that meets fewer rows is taken: the most frequent term isn't looked up at all (another one meets the row), or the counts
    that are passed over, of all terms, sum up to less than the floor."""
    sizes = shared.written(counts.groupBy("term", "tf").agg(F.count("*").alias("n")), "lexical-sizes")
    frequent = sizes.groupBy("term").agg(F.sum("n").alias("df"), F.max("tf").alias("most"))
    per = terms.join(frequent, "term").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
    per = shared.written(per.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("df"), "term"))), "lexical-frequent")
    levels = per.where("floor > 1").withColumn("tf", F.explode(F.sequence(F.lit(1), F.least("most", F.col("floor") - 1, F.lit(LEVELS)))))
    levels = levels.join(sizes, ["term", "tf"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = Window.partitionBy("query_id", "term").orderBy("tf").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("low"), "tf", "term")  # of a term, lower counts first
    passed = levels.withColumn("low", F.min("n").over(upto)).withColumn("taken", F.row_number().over(order)).where("taken < floor")
    passed = passed.groupBy("query_id", "term").agg(F.count("*").alias("passed"), F.sum("n").alias("saved"))
    both = per.join(passed, ["query_id", "term"], "left").fillna(0, ["passed", "saved"])
    of_query = Window.partitionBy("query_id")
    both = both.withColumn("without", F.max("df").over(of_query) >= F.sum("saved").over(of_query))
    return both.where("NOT (without AND place = 1)").select("query_id", "term", F.when(F.col("without"), F.lit(1)).otherwise(F.col("passed") + 1).alias("least"))


def expanded(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """Queries (query_id, terms, ...) with the glossary's terms that their text holds appended; matching then asks for these as well."""
    from sheafmill.operators import curation

    found = curation.substrings_in(queries.select("query_id", F.array_join("terms", " ").alias("text")), glossary.select("term"))
    more = found.groupBy("query_id").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("_more"))
    out = queries.join(more, "query_id", "left")
    return out.withColumn("terms", F.array_distinct(F.concat("terms", F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")


def fused(dense_hits: DataFrame, lexical_hits: DataFrame, k: int) -> DataFrame:
    """(query_id, id, dense_rank, lexical_rank, score, rank) by reciprocal ranks. A full outer join said as a union and one aggregate."""
    one = dense_hits.select("query_id", "id", F.col("rank").alias("dense_rank"), F.lit(None).cast("long").alias("lexical_rank"))
    two = lexical_hits.select("query_id", "id", F.lit(None).cast("long").alias("dense_rank"), F.col("rank").alias("lexical_rank"))
    both = one.unionByName(two).groupBy("query_id", "id").agg(F.max("dense_rank").alias("dense_rank"), F.max("lexical_rank").alias("lexical_rank"))
    return ranked(both.withColumn("score", measures.rrf(F.col("dense_rank")) + measures.rrf(F.col("lexical_rank"))), [F.desc("score"), "id"], k)


def fused_join(dense_hits: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """The fusion as a full outer join on (query_id, id)."""
    one = dense_hits.select("query_id", "id", F.col("rank").alias("dense_rank"))
    two = lexical_hits.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    return one.join(two, ["query_id", "id"], "full").withColumn("score", measures.rrf(F.col("dense_rank")) + measures.rrf(F.col("lexical_rank")))


def hybrid(
    queries: DataFrame, rows: DataFrame, k: int = 8, pool: int | None = None, match: str = "all", glossary: DataFrame | None = None, index: VectorIndex | None = None, postings: Postings | None = None,
    contents: DataFrame | None = None,
) -> DataFrame:
    """Fused hits with their contents: narrow lists are fused first, wide rows are fetched for the winners. A glossary (term) expands the
    lexical queries. Of stored indexes, the one of vectors is approximate; without them both sides are exact. `contents` are the rows' texts (id, content, collection, review), if they
    lie apart from the vectors."""
    pool = pool or pool_size(k)
    live, told = (x.where("review <> 'rejected'") for x in (rows, rows if contents is None else contents))
    asked = queries if glossary is None else expanded(queries, glossary)
    near = dense(queries, live, pool) if index is None else index.search(queries, live, pool)
    top = shared.written(fused(near, lexical(asked, told, pool, match, postings), k), "hybrid-top")
    return shared.small_or_shuffled(top, BROADCAST_HITS).join(told.select("id", "content", "collection"), "id")


def evaluated(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, recall_5, recall_10, mrr) from ranked hits and gold lists; a query without hits scores 0."""
    lists = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))
    rows = gold.join(lists, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    return rows.select("query_id", measures.recall_at(F.col("found"), F.col("gold"), 5).alias("recall_5"), measures.recall_at(F.col("found"), F.col("gold"), 10).alias("recall_10"), measures.reciprocal_rank(F.col("found"), F.col("gold")).alias("mrr"))


def evaluated_by_label(hits: DataFrame, asked: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, recall_5, recall_10, mrr) where the rows of a query's own label, itself left out, are gold: hits, at most some tens a query,
    meet the labels (id, label), and the number of gold rows comes from counts by label. Queries (query_id, label) without gold are left out."""
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_gold")).where("n_gold > 0")
    right = hits.join(labels.select("id", F.col("label").alias("found")), "id").join(asked, "query_id").where("found = label").select("query_id", "rank")
    per = right.groupBy("query_id").agg(F.count_if(F.col("rank") <= 5).alias("in_5"), F.count_if(F.col("rank") <= 10).alias("in_10"), F.min("rank").alias("first"))
    rows = asked.join(F.broadcast(shared.written(sizes, "eval-sizes")) if sizes.limit(100_001).count() <= 100_000 else sizes, "label").join(per, "query_id", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("n_gold")
    return rows.select("query_id", share("in_5").alias("recall_5"), share("in_10").alias("recall_10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


class Lists:
    """An inverted-file index: unit centroids, fitted on a bounded sample, and how many lists a query probes."""

    def __init__(self, vectors: np.ndarray, k: int, n_lists: int = 32, rounds: int = 8, recall: float = 0.97, seed: int = 5):
        random = np.random.default_rng(seed)
        unit = vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-12)
        self.centroids = unit[random.permutation(len(unit))[: max(1, min(n_lists, len(unit)))]] if len(unit) else np.zeros((1, vectors.shape[1]))
        for _ in range(rounds if len(unit) else 0):
            nearest = (unit @ self.centroids.T).argmax(axis=1)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, nearest, unit)
            norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            self.centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), self.centroids)
        self.probes = self.measured(unit, k, recall, random)

    def ranked(self, unit: np.ndarray) -> np.ndarray:
        """Lists from the nearest on, for each vector."""
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")

    def measured(self, unit: np.ndarray, k: int, recall: float, random: np.random.Generator) -> int:
        """The fewest probes that find the asked share of the sample's true neighbours."""
        if not len(unit):
            return 1
        asked = unit[random.permutation(len(unit))[:256]]
        true = np.argsort(-(asked @ unit.T), axis=1)[:, :k]
        order, home = self.ranked(asked), self.ranked(unit)[:, 0]
        place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], home[true]]
        return next((p for p in range(1, len(self.centroids) + 1) if (place < p).mean() >= recall), len(self.centroids))


def n_lists_for(n: int, least: int = 32, most: int = 2048) -> int:
    """About the root of the number of rows, so that lists and rows a list grow alike."""
    return max(least, min(most, int(n**0.5)))


def fitted(rows: DataFrame, k: int, sample: int = 4000, **kw: int) -> Lists:
    """Lists fitted on about `sample` rows at most, picked by hash; all rows, if there are fewer. Of large tables, as many rows are taken as
    give each list some ten, at most 20 480."""
    held = rows.where("embedding IS NOT NULL")
    n = held.count()
    kw = {"n_lists": n_lists_for(n)} | kw
    share = min(1.0, max(sample, 10 * kw["n_lists"]) / max(1, n))
    picked = held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 48)) < int(share * (1 << 48))).select("embedding").collect()
    return Lists(np.array([r[0] for r in picked], np.float64) if picked else np.zeros((0, 1)), k, **kw)


def dealt_to_lists(rows: DataFrame, key: str, lists: Lists, n: int) -> DataFrame:
    """(list, key, embedding): each row in its n nearest lists."""
    step = max(1, DEALT // max(n, len(lists.centroids)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), step):
                batch = whole.iloc[begin : begin + step]
                near = lists.ranked(np.stack([np.asarray(v, np.float64) for v in batch["embedding"]]))[:, :n]
                yield pd.DataFrame({"list": near.reshape(-1), key: np.repeat(batch[key].to_numpy(), near.shape[1]), "embedding": [v for v in batch["embedding"] for _ in range(near.shape[1])]})

    return rows.where("embedding IS NOT NULL").select(key, "embedding").mapInPandas(deal, f"list int, {key} long, embedding array<float>")


def index_search(queries: DataFrame, rows: DataFrame, k: int, **kw: int) -> DataFrame:
    """Approximate nearest rows: every row is in one list, a query meets the lists that it probes, and candidates are scored exactly. Lists are
    cut into blocks of rows, queries of a list into blocks of queries, and a pair of blocks keeps k a query."""
    lists = fitted(rows, k, **kw)
    held = shared.written(dealt_to_lists(rows, "id", lists, 1), "index-lists")
    probes = shared.written(dealt_to_lists(queries, "query_id", lists, lists.probes), "index-probes")
    blocks = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(held, ROW_BLOCK, "n_r").join(blocks(probes, QUERY_BLOCK, "n_q"), "list"))  # a row a list
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = held.join(sizes, "list").withColumn("rb", block("id", "n_r")).withColumn("qb", every("n_q"))
    q = probes.join(sizes, "list").withColumn("qb", block("query_id", "n_q")).withColumn("rb", every("n_r"))
    key = ["list", "qb", "rb"]
    met = q.select(*key, "query_id", "embedding").groupBy(*key).cogroup(r.select(*key, "id", "embedding").groupBy(*key))
    return ranked(met.applyInPandas(lambda left, right: nearest_in_block(left, right, k), "query_id long, id long, distance double"), ["distance", "id"], k)
