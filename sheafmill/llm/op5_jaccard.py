"""Exact Jaccard join of shingle sets in metric space, with the classes of linked documents.

Equal sets are one node. Distances between unrelated documents all lie near 1, where no pivot parts them; so a pivot's region is
found by projection first. Two linked sets differ in at most D of their shingles, so if the shingles' hash space is cut into
D + 1 parts, they are equal on one part at least. If either has shingles in more than D parts, they are equal on a filled one, so empty parts need no
cells; where parts hold few shingles, some are cut in excess of D + 1 for that. Sets with shingles in D parts or fewer, which are small and rare, meet on their least
shingles besides: two linked sets share one of those that stand before the number of shingles they must share. Sizes are cut into levels, D is a level's, and a set near a level's
upper end is also dealt into the next one. Sets equal on a part share a cell. A cell's pivot is its member with the most
shared cells; cells with the same pivot and level form the pivot's region, a Voronoi cell in that each node joins the most central
pivots that it can be near to.

Inside a region distances are those of sketches, four bits for each of 1024 parts of the hash space: in how many parts two differ. That is a
metric, at most the number of shingles in which the sets differ, and for sets of some hundred shingles hardly less. Nodes linked with the pivot are joined through it, so that a group of copies around one text
costs a comparison a copy. If others, open ones, are there, the region is cut into rings of D + 1 around the pivot: by the triangle
inequality a linked pair lies in one ring or in two neighbouring ones, so each node is also dealt to the next ring. Only pairs with an
open node are left to compare: a ring's open nodes and its joined ones part into blocks, and each block of open nodes meets every block
once. Pairs within D by sketch are then compared by their whole sets; large sets, of which such a sketch says little, first by sketches as wide as they are. Nothing is capped: every pair at the similarity or more either
shares a pivot's link or is compared. Classes come from minimum labels with pointer jumping over written tables.

Equality of shingles and parts is that of 64-bit hashes, that of sets of two such hashes and the size. A node is named by the first hash; nodes on which different
sets meet, a few among 10^10, are named anew by both.

Defined cases: null or blank text has an empty set and is linked with nothing; under n words the whole sequence is the one
shingle; repeated rows are one document; rows of one doc_id with different texts are documents of their own; a null doc_id never
names a class that has another; columns whose names begin with _sm_ are reserved in `one_each`; no rows give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common
from sheafmill.llm.shingles import mix, shingles


class Near(NamedTuple):
    """Shingles of so many words; linked if num * union <= den * intersection."""

    words: int
    num: int
    den: int

    def most_differing(self, total):
        """The most shingles in which two linked sets of `total` shingles together differ."""
        return (self.den - self.num) * total // (self.den + self.num)


#: What op5_jaccard_join links.
CONTRACT = Near(3, 90, 100)
#: A sketch has four bits for each of so many parts of the hash space.
SKETCH_PARTS = 1024
#: Sets of more shingles than this, which sketches no longer tell apart, have sketches as wide as themselves, made for candidate pairs alone.
WIDE_FROM = 2048
BLOCK = 256
#: Lists of ids (8 to 24 bytes a row), and of shared cells (8 bytes each), that a join may broadcast; beyond so many rows it shuffles.
BROADCAST_ROWS, BROADCAST_CELLS = 200_000, 1_000_000

PROJECTED = "doc_id long, text_hash long, n_shingles long, node long, twin long, level int, sketch binary, cells array<long>, next_cells array<long>"


def level_starts(most: int, near: Near) -> np.ndarray:
    """The least sizes of the levels; a linked pair's sizes are of one level or of two neighbouring ones."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(next_start(starts[-1], near))
    return np.array(starts, np.int64)


def next_start(start: int, near: Near) -> int:
    return max(start + 1, -(-start * 4 // 3), -(-start * near.den // near.num))


def part_sums(hashes: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
    counts = np.bincount(parts, minlength=n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(99))[np.argsort(parts, kind="stable")])])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def cells_of(hashes: np.ndarray, level: int, upper: int, near: Near) -> np.ndarray:
    """A set's cells on a level: one hash a filled part, of the part's place and shingles. A set with no more filled parts than may differ has a cell for each
    of its least shingles as well, enough of them that two such sets, if linked, share one."""
    most = near.most_differing(2 * upper)
    n = most + 1 + round(2 * (most + 1) * np.exp(-0.75 * upper / (most + 1)))
    parts = ((hashes >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
    cells = mix(part_sums(hashes, parts, n) * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(level)).view(np.int64)
    full = np.bincount(parts, minlength=n) > 0
    if full.sum() > most:
        return cells[full]
    least = np.sort(hashes)[: len(hashes) + 1 - -(-near.num * len(hashes) // near.den)]
    return np.concatenate([cells[full], mix(least * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xA24BAED4963EE407) + np.uint64(level)).view(np.int64)])


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Four bits a part of the hash space, of the part's shingles: 512 bytes."""
    fours = (mix(part_sums(hashes, (hashes & np.uint64(SKETCH_PARTS - 1)).astype(np.int64), SKETCH_PARTS)) >> np.uint64(60)).astype(np.uint8)
    return fours[::2] | fours[1::2] << 4


def wide_sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Four bits a part, of about as many parts as the set has shingles: the XOR of its shingles' bits, so that a sketch folds into one of half its parts."""
    parts = 1 << max(1, (len(hashes) - 1).bit_length())
    at = (hashes & np.uint64(parts - 1)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    fours = np.zeros(parts, np.uint8)
    fours[at[order][starts]] = np.bitwise_xor.reduceat((mix(hashes[order] + np.uint64(7)) >> np.uint64(60)).astype(np.uint8), starts)
    return fours[::2] | fours[1::2] << 4


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def set_hash(found: np.ndarray, seed: int) -> int:
    """A hash of a whole set."""
    total = mix(found + np.uint64(seed)).sum() + np.uint64(len(found))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def projected(docs: DataFrame, near: Near = CONTRACT, seed: int = 0) -> DataFrame:
    """A row a document: its node (a hash of its set), a second hash, level, sketch and cells."""
    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True):
                doc_id, found = None if pd.isna(doc_id) else int(doc_id), shingles(text, near.words)
                if not len(found):
                    rows.append((doc_id, text_hash, 0, None, None, None, None, [], []))
                    continue
                starts = level_starts(len(found), near)
                level = int(np.searchsorted(starts, len(found), "right")) - 1
                near_next = near.den * len(found) >= near.num * starts[level + 1]
                after = next_start(int(starts[level + 1]), near)
                next_cells = cells_of(found, level + 1, after - 1, near) if near_next else []
                rows.append((doc_id, text_hash, len(found), set_hash(found, seed), set_hash(found, ~seed & 0xFFFF_FFFF), level, sketch_of(found).tobytes(), cells_of(found, level, int(starts[level + 1]) - 1, near), next_cells))
            out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "n_shingles", "node", "twin", "level", "sketch", "cells", "next_cells"], dtype=object)
            yield out.astype({"doc_id": "Int64", "text_hash": "Int64", "n_shingles": "Int64", "node": "Int64", "twin": "Int64", "level": "Int32"})

    # ids as text: beside a null, pandas would round them to doubles
    return common.written(keyed(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(project, PROJECTED), "op5-projected")


def by_node_of(rows: DataFrame) -> DataFrame:
    """The written table of (node, id, same, first, n): a node's least doc_id, whether all its rows have one size and second hash, its first row by
    doc_id and hash of the text, and how many it has."""
    same = (F.min("n_shingles") == F.max("n_shingles")) & (F.min("twin") == F.max("twin"))
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    return common.written(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), same.alias("same"), first, F.count("*").alias("n")), "op5-by-node")


def once_a_node(rows: DataFrame, by_node: DataFrame) -> DataFrame:
    """`rows` (doc_id, text_hash, node ...) without those of a node that aren't like its first."""
    several = common.small_or_shuffled(by_node.where("n > 1").select("node", "first"), BROADCAST_ROWS)
    copies = rows.select("node", "doc_id", "text_hash").join(several, "node").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
    copies = common.written(copies.select(F.col("doc_id").alias("copy_id"), F.col("text_hash").alias("copy_hash")).distinct(), "op5-copies")
    copies = common.small_or_shuffled(copies, BROADCAST_ROWS)
    return rows.where("node IS NOT NULL").join(copies, rows["doc_id"].eqNullSafe(copies["copy_id"]) & (rows["text_hash"] == copies["copy_hash"]), "left_anti")


def regions(held: DataFrame) -> DataFrame:
    """(pivot, level, node) for each node but the pivot in each pivot's region, from rows of a node each. Cells are counted first, by themselves: hardly any is met twice, and
    the nodes of those that are follow."""
    own, next_ = held.select("node", "level", F.explode("cells").alias("cell")), held.select("node", (F.col("level") + 1).alias("level"), F.explode("next_cells").alias("cell"))
    cells = own.unionByName(next_)
    shared = common.written(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "op5-shared")
    members = common.written(cells.join(common.small_or_shuffled(shared, BROADCAST_CELLS), "cell", "left_semi").distinct(), "op5-members")
    central = members.groupBy("node").agg(F.count("*").alias("n_cells"))
    pivots = members.join(central, "node").groupBy("cell").agg(F.max(F.struct("n_cells", "node")).alias("top")).select("cell", F.col("top.node").alias("pivot"))
    return common.written(members.join(pivots, "cell").where("node <> pivot").select("pivot", "level", "node").distinct(), "op5-regions")


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, near: Near, seed: int, as_made: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """The written table of (node, n, shingles) of the wanted nodes, from the texts that nodes (node, of) name; in place of the shingles what `as_made` makes of them."""
    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, near.words) for t in batch["text"]]
            right = [len(x) > 0 and set_hash(x, ~seed & 0xFFFF_FFFF) == twin for x, twin in zip(sets, batch["twin"], strict=True)]  # not another text of the same hash
            sets = [x for x, r in zip(sets, right, strict=True) if r]
            yield pd.DataFrame({"node": batch["node"][right], "n": [len(x) for x in sets], "shingles": [as_made(x).tobytes() for x in sets]})

    named = nodes.select("node", "twin", F.col("of.doc_id").alias("of_id"), F.col("of.text_hash").alias("of_hash")).join(wanted, "node", "left_semi")
    named = common.small_or_shuffled(common.written(named, "op5-named"), BROADCAST_ROWS)
    texts = keyed(docs)
    texts = texts.join(named, (texts["text_hash"] == named["of_hash"]) & texts["doc_id"].eqNullSafe(named["of_id"]))
    return common.written(texts.select("node", "twin", "text").mapInPandas(shingled, "node long, n long, shingles binary").dropDuplicates(["node"]), "op5-sets")


def met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with n and set of both."""
    sets = common.small_or_shuffled(sets, BROADCAST_ROWS, F.octet_length("shingles"))
    sides = [sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("shingles").alias(f"set_{k}")) for k in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b")


def both_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def near_by_width(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, near: Near, seed: int, label: str) -> DataFrame:
    """The written pairs (a, b) without those of two large sets that their wide sketches show to be too far apart. A wide sketch is a sixteenth of its set."""
    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for n, m, x, y in zip(batch["n_a"], batch["n_b"], batch["set_a"], batch["set_b"], strict=True):
                size = min(len(x), len(y))
                kept.append(differing(folded(np.frombuffer(x, np.uint8), size), folded(np.frombuffer(y, np.uint8), size)) <= near.most_differing(n + m))
            yield batch.loc[kept, ["a", "b"]]

    large = common.small_or_shuffled(common.written(nodes.where(F.col("n") > WIDE_FROM).select("node"), f"{label}-large"), BROADCAST_ROWS)
    wide = common.written(pairs.join(large.withColumnRenamed("node", "a"), "a", "left_semi").join(large.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"), f"{label}-wide")
    sketches = sets_of(docs, nodes, both_of(wide), near, seed, wide_sketch_of)
    told = met(wide, sketches).select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInPandas(tell, "a long, b long")
    return common.written(pairs.join(wide, ["a", "b"], "left_anti").unionByName(told), f"{label}-pairs")


def compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, near: Near, seed: int, label: str) -> DataFrame:
    """The written table of those of the pairs (a, b) that are linked, by their whole sets. Only sets of nodes in a pair are made."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(near.den * both >= near.num * (len(x) + len(y) - both))
            yield batch.loc[linked, ["a", "b"]]

    pairs = near_by_width(docs, nodes, common.written(pairs.distinct(), f"{label}-candidates"), near, seed, label)
    sets = sets_of(docs, nodes, both_of(pairs), near, seed)
    return common.written(met(pairs, sets).select("a", "b", "set_a", "set_b").mapInPandas(compare, "a long, b long"), label)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many parts sketches differ."""
    apart = x ^ y
    return ((apart & 15) != 0).sum(axis=-1) + (apart > 15).sum(axis=-1)


def near_by_sketch(batches: Iterator[pd.DataFrame], near: Near) -> Iterator[pd.DataFrame]:
    """Distance and verdict by sketches for rows of pivot, level, node, and both sides' n and sketch."""
    for batch in batches:
        if len(batch):
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, SKETCH_PARTS // 2) for c in ("sketch", "pivot_sketch"))
            apart = differing(x, y)
            total = (batch["n"] + batch["pivot_n"]).to_numpy()
            yield batch[["pivot", "level", "node", "n", "sketch"]].assign(apart=apart, may_link=apart <= near.most_differing(total))


def met_in_block(rows: pd.DataFrame, near: Near) -> pd.DataFrame:
    """Pairs of a block of a ring that may be linked: not both guests, not both joined through the pivot, near by size and sketch."""
    rows = rows.drop_duplicates("node")
    nodes, n, guest, joined, side = (rows[c].to_numpy() for c in ("node", "n", "guest", "joined", "side"))
    sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, SKETCH_PARTS // 2)
    across = bool(rows["across"].iloc[0])
    out = []
    for i in range(len(rows) - 1):
        fit = ~(joined[i] & joined[i + 1 :]) & ~(guest[i] & guest[i + 1 :]) & (near.den * np.minimum(n[i], n[i + 1 :]) >= near.num * np.maximum(n[i], n[i + 1 :]))
        if across:
            fit &= side[i] != side[i + 1 :]
        j = np.nonzero(fit)[0] + i + 1
        if len(j):
            j = j[differing(sketches[j], sketches[i]) <= near.most_differing(n[i] + n[j])]
            out.append(np.stack([np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])], axis=1))
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])


def links(docs: DataFrame, rows: DataFrame, by_node: DataFrame, near: Near = CONTRACT, seed: int = 0) -> DataFrame:
    """Links (a, b) between nodes of different sets that join each class; rows is `projected(docs, near, seed)`, by_node its `by_node_of`."""
    held = once_a_node(rows, by_node)
    region = regions(held)
    nodes = held.select("node", "twin", F.struct("doc_id", "text_hash").alias("of"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node"])
    ids = region.select("node").union(region.select("pivot")).distinct()
    nodes = common.written(nodes.join(common.small_or_shuffled(common.written(ids, "op5-ids"), BROADCAST_ROWS), "node", "left_semi"), "op5-nodes")

    pivots = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))
    around = region.join(nodes.drop("of", "twin"), "node").join(pivots, "pivot").select("pivot", "level", "node", "n", "sketch", "pivot_n", "pivot_sketch")
    around = common.written(around.mapInPandas(lambda batches: near_by_sketch(batches, near), "pivot long, level int, node long, n long, sketch binary, apart long, may_link boolean"), "op5-around")
    first = compared(docs, nodes, around.where("may_link").select(F.col("node").alias("a"), F.col("pivot").alias("b")), near, seed, "op5-linked")

    marked = around.join(first.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("is_linked")), ["node", "pivot"], "left")
    widths = [near.most_differing(2 * (int(start) - 1)) + 1 for start in level_starts(10**9, near)[1:]]
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("level") + 1)
    marked = marked.select("pivot", "level", "node", "n", "sketch", F.col("is_linked").isNotNull().alias("joined"), F.floor(F.col("apart") / width).cast("int").alias("ring"))
    # a pivot links with none of the others: it needs no place in its own rings
    dealt = marked.withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("ring", F.col("ring") + F.col("guest").cast("int"))
    dealt = common.written(dealt, "op5-dealt")
    key = ["pivot", "level", "ring"]
    counts = [F.count_if(~F.col("joined")).alias("n_open"), F.count_if("joined").alias("n_joined"), F.count_if(~F.col("guest")).alias("n_home")]
    open_rings = dealt.groupBy(key).agg(*counts).where("n_open > 0 AND n_home > 0 AND n_open + n_joined > 1")
    blocks = [F.ceil(F.col(n) / BLOCK).cast("int").alias(b) for n, b in (("n_open", "open_blocks"), ("n_joined", "joined_blocks"))]
    open_rings = common.written(open_rings.select(*key, *blocks), "op5-rings")
    dealt = dealt.join(common.small_or_shuffled(open_rings, BROADCAST_ROWS), key)
    block = F.when(F.col("joined"), F.col("open_blocks") + F.pmod(F.xxhash64("node"), F.col("joined_blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("open_blocks")))
    met = F.col("open_blocks") + F.when(F.col("joined"), 0).otherwise(F.col("joined_blocks"))
    dealt = dealt.withColumn("side", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    dealt = dealt.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).withColumn("across", F.col("low") != F.col("high"))
    pairs = dealt.select(*key, "low", "high", "across", "side", "node", "n", "sketch", "joined", "guest").groupBy(*key, "low", "high").applyInPandas(lambda rows: met_in_block(rows, near), "a long, b long")
    return first.union(compared(docs, nodes, pairs, near, seed, "op5-met"))


def classes(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id that has a link; links have two columns of ids."""
    pairs = links.toDF("id", "other")
    both = common.written(pairs.union(pairs.select("other", "id")).distinct(), "op5-links")
    labels = common.written(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")), "op5-labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("other"), F.col("label").alias("heard")), "other").groupBy("id").agg(F.min("heard").alias("heard"))
        lower = common.written(labels.join(heard, "id").select("id", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "op5-heard")
        top = lower.select(F.col("id").alias("label"), F.col("label").alias("top"))
        jumped = common.written(lower.join(top, "label").select("id", "old", F.least("label", "top").alias("label")), "op5-labels")
        if jumped.where("label <> old").limit(1).count() == 0:
            return jumped.select("id", F.col("label").alias("component"))
        labels = jumped.select("id", "label")


def parted(rows: DataFrame, by_node: DataFrame) -> DataFrame:
    """The written `rows`, with new names for the nodes on which different sets meet: a hash of what tells the sets apart."""
    mixed = common.small_or_shuffled(by_node.where("NOT same").select("node", F.lit(True).alias("mixed")), BROADCAST_ROWS)
    named = F.when(F.col("mixed"), F.xxhash64("node", "twin", "n_shingles")).otherwise(F.col("node"))
    return common.written(rows.join(mixed, "node", "left").withColumn("node", named).select(rows.columns), "op5-parted")


def classed(docs: DataFrame, near: Near = CONTRACT, seed: int = 1) -> DataFrame:
    """doc_id, text_hash, n_shingles, label (a node that stands for the class; null for an empty set) and component_id, for each row."""
    with common.small_batches(docs.sparkSession):
        rows = projected(docs, near, seed)
        by_node = by_node_of(rows)
        while by_node.where("NOT same").limit(1).count():
            rows = parted(rows, by_node)
            by_node = by_node_of(rows)
        of = common.written(classes(links(docs, rows, by_node, near, seed)).toDF("node", "label"), "op5-of")
    least = common.written(of.join(by_node.select("node", "id"), "node").groupBy("label").agg(F.min("id").alias("least")), "op5-least")
    named = by_node.join(of.join(least, "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("least", "id").alias("component"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(common.written(named, "op5-named"), "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "label", F.coalesce("component", "doc_id").alias("component_id"))


def joined(docs: DataFrame, near: Near = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, component_id) a row."""
    return classed(docs, near).select("doc_id", "n_shingles", "component_id")


def one_each(docs: DataFrame, near: Near = CONTRACT) -> DataFrame:
    """The rows of `docs`, all columns, of one document a class: of the least doc_id, then the least hash of its text; of rows that are
    equal in both, one."""
    key = ["doc_id", "text_hash"]
    rows = common.written(classed(docs, near).select(*key, "label").groupBy(*key).agg(F.first("label").alias("label"), F.count("*").alias("times")), "op5-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *key)).alias("first")
    several = rows.where("label IS NOT NULL").groupBy("label").agg(first, F.count("*").alias("n")).where("n > 1").select("label", "first")
    others = rows.join(common.small_or_shuffled(common.written(several, "op5-several"), BROADCAST_ROWS), "label")
    others = others.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))

    marked = docs.withColumn("_sm_hash", F.xxhash64(F.col("text").cast("binary")))
    side = lambda df, label: common.small_or_shuffled(common.written(df.select(F.col("doc_id").alias("_sm_id"), F.col("text_hash").alias("_sm_text")), label), BROADCAST_ROWS)
    same = lambda left, right: left["doc_id"].eqNullSafe(right["_sm_id"]) & (left["_sm_hash"] == right["_sm_text"])
    gone, repeated = side(others, "op5-gone"), side(rows.where("times > 1"), "op5-repeated")
    kept = marked.join(gone, same(marked, gone), "left_anti")
    once = kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(["doc_id", "_sm_hash"])
    return kept.join(repeated, same(kept, repeated), "left_anti").unionByName(once).drop("_sm_hash")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
h AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS hs FROM w),
s AS (SELECT doc_id, len(hs)::BIGINT AS n, unnest(hs) AS x FROM h),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 90 * (na + nb - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(hs)::BIGINT AS n_shingles, component_id FROM h JOIN c ON a = doc_id
"""
