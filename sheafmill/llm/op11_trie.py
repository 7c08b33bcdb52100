"""Prefix trie of conversations by depth-band rollup.

A node is a distinct sequence of first turns; the root is the empty one. Nodes are named by 128 bits: the XOR of two 64-bit hashes of each turn and its place, so
that a conversation's nodes come from running XORs. These run inside bands of BAND places; the bands' own totals are run in the same way one level
up, where BAND bands form a band, and so on: no conversation, however long, has to stand in one window.

Totals of subtrees come from the same bands. A node is exploded to its ancestors inside its band alone, at most BAND rows, which are summed at once: that
gives each node its total within the band. The roots of bands form a tree by themselves, a BAND-th as deep, which is rolled up in the same way; a completed
band root's total is then added to the ancestors of its parent in the band above, again at most BAND rows. So a trie of depth d takes about
log(d) / log(BAND) rounds, and no node more than 2 * BAND rows. Sums are formed before they are shuffled, so that a node with any number of descendants is a
row a task.

Who ends at a node is told by a digest of all ids in order. Ids are sorted by range, so that a node with a large share of them lies in many tasks; each packs its runs
into texts, a batch of ids at most, and only these pass, in order and one at a time, through the task that digests a node.

Defined cases: rows of a null conv_id belong to no conversation; a null role or text is an empty one; a null turn stands first; rows of one turn stand by the
digest of their role and text, repeated rows each as a turn of its own; conversations without turns end at the root; other columns are not read; no
rows give no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafmill.llm import common
from sheafmill.operators import ordering

BAND = 16
#: Conversations with the lengths of their parts (40 bytes), and nodes by name (40 bytes), are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 200_000
KEY = ["k1", "k2"]


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, n, turn_hash, chars): the turns of each conversation, numbered from 1 on."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn_hash = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    narrow = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_hash.alias("turn_hash"), F.length(text).cast("long").alias("chars"))
    return ordering.numbered(narrow, ["conv_id"], ["turn", "turn_hash"]).select("conv_id", "n", "turn_hash", "chars")


def rebuilt(turns: DataFrame, base: Column, heads: Column, most_heads: int) -> tuple[DataFrame, DataFrame]:
    """Of each conversation c the first `heads` turns of conversation `base`, then its own behind its first `heads`; both are expressions of conv_id, a base
    is its own base, and `heads` at most `most_heads`. The written tables of the conversations (conv_id, length) and of their turns (conv_id, place, turn_hash, chars, last)."""
    turns = common.written(turns, "op11-turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")).withColumn("base", base).withColumn("heads", heads.cast("long"))
    turn = F.struct("n", "turn_hash", "chars")
    first = turns.where((F.col("conv_id") == base) & (F.col("n") <= most_heads)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("first"))
    convs = convs.join(first, "base", "left").withColumn("first", F.slice("first", F.lit(1), F.col("heads").cast("int")))
    convs = convs.withColumn("taken", F.coalesce(F.size("first"), F.lit(0)).cast("long")).withColumn("taken", F.greatest("taken", F.lit(0)))
    convs = common.written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n_turns") - F.col("heads"), F.lit(0))), "op11-convs")
    given = convs.select("conv_id", "length", F.posexplode("first").alias("at", "turn")).select("conv_id", "length", (F.col("at") + 1).cast("long").alias("place"), "turn.turn_hash", "turn.chars")
    own = turns.join(common.small_or_shuffled(convs.select("conv_id", "length", "heads", "taken"), BROADCAST_ROWS), "conv_id").where("n > heads")
    own = own.select("conv_id", "length", (F.col("n") - F.col("heads") + F.col("taken")).alias("place"), "turn_hash", "chars")
    return convs.select("conv_id", "length"), given.unionByName(own).select("conv_id", "place", "turn_hash", "chars", (F.col("place") == F.col("length")).alias("last"))


def running(rows: DataFrame, last_place: int) -> DataFrame:
    """`rows` (conv_id, place from 0 on, x1, x2 ...) with k1 and k2, the XOR of x1 and of x2 up to their place."""
    rows = rows.withColumn("band", F.floor(F.col("place") / BAND))
    inside = Window.partitionBy("conv_id", "band").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.bit_xor(x).over(inside) for k, x in (("k1", "x1"), ("k2", "x2"))})
    if last_place < BAND:
        return rows.drop("band")
    rows = common.written(rows, "op11-inside")
    bands = rows.groupBy("conv_id", "band").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")).withColumnRenamed("band", "place")
    bands = running(common.written(bands, "op11-bands"), last_place // BAND)
    bands = bands.where("place > 0").select("conv_id", F.col("place").alias("band"), *[F.col(k).bitwiseXOR(F.col(x)).alias(f"{k}_before") for k, x in (("k1", "x1"), ("k2", "x2"))])
    later = rows.where("band > 0").join(bands, ["conv_id", "band"]).withColumns({k: F.col(k).bitwiseXOR(F.col(f"{k}_before")) for k in KEY})
    return rows.where("band = 0").unionByName(later.select(rows.columns)).drop("band")


def with_paths(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, place, k1, k2 ...) with `path`, the names of the nodes of their band up to their own, and guest: false. A band's first node is there a second
    time, as a guest, with the path of the band above that leads to it."""
    above = rows.where((F.col("place") > 0) & (F.col("place") % BAND == 0)).withColumn("guest", F.lit(True)).withColumn("band", F.floor(F.col("place") / BAND) - 1)
    dealt = rows.withColumn("guest", F.lit(False)).withColumn("band", F.floor(F.col("place") / BAND)).unionByName(above)
    inside = Window.partitionBy("conv_id", "band").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("path", F.collect_list(F.struct(*KEY)).over(inside))
    return dealt.withColumn("path", F.when(F.col("guest"), F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path"))).drop("band")


def summed(rows: DataFrame, values: list[str]) -> DataFrame:
    """The values of rows (path, values) by each node of their path."""
    rows = rows.select(F.explode("path").alias("node"), *values).select("node.*", *values)
    return rows.groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values])


def rolled_up(rows: DataFrame, own: DataFrame, values: list[str], last_place: int) -> DataFrame:
    """The written table of (k1, k2, values): the sums of the nodes' own values (k1, k2, values) over their subtrees. `rows` is a written table of
    (conv_id, place, k1, k2), with place 0 for the root."""
    dealt = common.written(with_paths(rows.select("conv_id", "place", *KEY)), "op11-paths")
    nodes = dealt.where("NOT guest").groupBy(*KEY).agg(F.first("path").alias("path"))
    inside = common.written(summed(nodes.join(own, KEY), values), "op11-inside-bands")
    if last_place < BAND:
        return inside
    roots = common.written(rows.where(F.col("place") % BAND == 0).select("conv_id", F.floor(F.col("place") / BAND).alias("place"), *KEY), "op11-roots")
    below = rolled_up(roots, inside, values, last_place // BAND)
    guests = dealt.where("guest").groupBy(*KEY).agg(F.first("path").alias("path"))
    across = summed(guests.join(below, KEY), values)
    return common.written(inside.unionByName(across).groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values]), "op11-totals")


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (k1, k2, conv_id), in order, as a row a node and batch with its ids joined by commas."""
    for batch in batches:
        if len(batch):
            runs = (batch[KEY] != batch[KEY].shift()).any(axis=1).cumsum()
            ids = batch["conv_id"].astype(str)
            yield pd.DataFrame({"k1": batch.groupby(runs)["k1"].first(), "k2": batch.groupby(runs)["k2"].first(), "least": batch.groupby(runs)["conv_id"].first(), "ids": ids.groupby(runs).agg(",".join)})


def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (k1, k2, ids), a node's in order and side by side, as a row a node with the digest of all of its ids. One text is held at a time."""
    at, state = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(batch["k1"], batch["k2"], batch["ids"], strict=True):
            if (k1, k2) != at:
                out += [(*at, state.hexdigest())] if at else []
                at, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
    if at:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=[*KEY, "ends_sha256"])


def ends_of(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes at which conversations end, from rows (k1, k2, conv_id), one a conversation."""
    order = [*KEY, "conv_id"]
    runs = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(packed, "k1 long, k2 long, least long, ids string")
    runs = common.written(runs, "op11-runs")
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInPandas(digested, "k1 long, k2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row a node: k1, k2 (its name), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. convs is (conv_id, length),
    a row a conversation; turns is (conv_id, place from 1 on, turn_hash, chars, last)."""
    name = lambda *salt: F.xxhash64(*salt, "place", "turn_hash")
    rows = turns.select("conv_id", "place", "chars", "last", name().alias("x1"), name(F.lit(1)).alias("x2"))
    root = {"place": F.lit(0).cast("long"), "chars": F.lit(0).cast("long"), "last": F.col("length") == 0, "x1": F.lit(0).cast("long"), "x2": F.lit(0).cast("long")}
    rows = rows.unionByName(convs.select("conv_id", *[v.alias(k) for k, v in root.items()]))
    last_place = convs.agg(F.max("length")).first()[0] or 0
    rows = common.written(running(common.written(rows, "op11-rows"), last_place), "op11-named")

    parent = [F.first(F.col(k).bitwiseXOR(F.col(x))).alias(p) for k, x, p in (("k1", "x1", "p1"), ("k2", "x2", "p2"))]
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.first("place").alias("depth"), *parent, F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.first("chars").alias("chars"))
    nodes = common.written(nodes, "op11-nodes")
    own = nodes.select(*KEY, (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rolled_up(rows, own, ["n_leaves", "saved_tokens"], last_place)
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = common.small_or_shuffled(nodes.where("n_ends < n_convs").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth")), BROADCAST_ROWS)
    out = nodes.join(totals, KEY).join(children, KEY, "left").join(ends_of(rows.where("last")), KEY, "left").join(parents, ["p1", "p2", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        *KEY, "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    heads = F.crc32(conv_id.cast("string").cast("binary")) % 6
    convs, turns = rebuilt(turns_of(common.load(spark, sf_dir, "conversations")), conv_id - conv_id % 100, heads, 5)
    return trie(convs, turns).drop(*KEY)


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT conv_id AS c, list({'k': length(r)::VARCHAR || ':' || r || length(x)::VARCHAR || ':' || x, 'n': length(x)} ORDER BY turn NULLS FIRST, md5(length(r)::VARCHAR || ':' || r || x)) AS ts FROM t GROUP BY conv_id),
h AS (SELECT c, c - c % 100 AS b, ts, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda a, y: list_reduce(list_concat([xor(a, y)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda q, z: xor(q >> 1, CASE WHEN q & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 6 AS h FROM v),
f AS (SELECT h.c, list_concat(coalesce(v.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN v ON v.c = h.b),
m AS (SELECT c, d, md5(array_to_string(list_transform(ts[1:d], lambda z: z.k), '')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(ts[1:d - 1], lambda z: z.k), '')) END AS p,
  CASE WHEN d > 0 THEN ts[d].n ELSE 0 END AS n, d = len(ts) AS last FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM f)),
s AS (SELECT k, d, min(c) AS conv_id, any_value(p) AS p, count(*) AS n_convs, any_value(n) AS n, bool_and(last) AS leaf, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY k, d),
e AS (SELECT DISTINCT a.k AS a, a.d AS ad, b.k, b.d FROM m a JOIN m b ON a.c = b.c AND a.d <= b.d),
z AS (SELECT a, ad, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens FROM e JOIN s USING (k, d) GROUP BY a, ad),
g AS (SELECT p, d - 1 AS d, count(*) AS n_children FROM s WHERE d > 0 GROUP BY ALL)
SELECT s.conv_id, s.d::BIGINT AS depth, o.conv_id AS parent_conv_id, s.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, s.ends_sha256
FROM s JOIN z ON z.a = s.k AND z.ad = s.d LEFT JOIN g ON g.p = s.k AND g.d = s.d LEFT JOIN s o ON o.k = s.p AND o.d = s.d - 1
"""
