"""Exact dedup against a persistent index of digests.

The index is a table of one row a different text: its digest, the doc_id that stands for it and the batch that brought it. It is bucketed and sorted by
digest, in as many buckets as were asked for when it was begun, and lives in a folder of its own, so that any session can open it again. A batch of
documents is digested and grouped, so that a group of copies of any size is a row from then on; a sort-merge anti-join with the index, whose side is neither shuffled nor
dealt anew, leaves the digests that are new; these are appended, each bucket by one task. An append is committed whole or not at all, and
a batch that is added again under its name adds nothing and is judged as the first time. Files pile up by one a bucket and batch; `rebuilt` merges them, in more
buckets if the index has grown.

Texts are equal when they are identical after lower-casing A-Z. Of equal texts of one batch the row with the largest doc_id stays; a text that an earlier
batch has brought goes whatever its doc_id.

Defined cases: null text is an empty one; a null doc_id is less than any other; of repeated rows, equal in doc_id and text, one alone stays; a batch without rows
adds nothing; columns whose names begin with _sm_ are reserved in `filtered`, and no others but doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common

BUCKETS = 64
#: Digests of several rows, with what is known of them (about 80 bytes), are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class DigestIndex:
    """The index at `path`: opened if it is there, else begun with `buckets` buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, layout = spark, path, f"{path}/layout"
        at = spark._jvm.org.apache.hadoop.fs.Path(layout + "/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(layout)
        self.buckets = spark.read.parquet(layout).first()["buckets"]
        self.name = f"sm_digests_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/digests'"
        )

    def rows(self) -> DataFrame:
        """(digest, keep_id, batch), a row a digest."""
        return self.spark.table(self.name)

    def dealt(self, groups: DataFrame) -> DataFrame:
        """`groups` as the index is dealt out, so that it needs no shuffle to be joined."""
        return groups.repartition(self.buckets, "digest")

    def unknown(self, groups: DataFrame) -> DataFrame:
        """Those of the groups (digest ...), a row a digest, that the index hasn't."""
        return self.dealt(groups).join(self.rows().hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame, batch: str) -> None:
        """Appends the unknown ones of the groups (digest, top_id)."""
        self.unknown(groups.select("digest", "top_id")).select("digest", F.col("top_id").alias("keep_id"), F.lit(batch).alias("batch")).write.insertInto(self.name)

    def known(self, groups: DataFrame) -> DataFrame:
        """The groups (digest ...) with the keep_id and batch that the index has for them."""
        return self.dealt(groups).join(self.rows().hint("merge"), "digest")

    def rebuilt(self, path: str, buckets: int | None = None) -> DigestIndex:
        """A copy at `path`, a file a bucket."""
        copy = DigestIndex(self.spark, path, buckets or self.buckets)
        copy.dealt(self.rows()).write.insertInto(copy.name)
        return copy


def digest_of(text: Column) -> Column:
    """The 32 bytes that equal texts share."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


def digested(docs: DataFrame) -> DataFrame:
    """The written table of (doc_id, digest, row); row numbers the rows, in no order."""
    return common.written(docs.select("doc_id", digest_of(docs["text"]).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "op13-digests")


def merged(groups: DataFrame, size: Column) -> DataFrame:
    """(digest, group_size, top_id, row): how many, the largest doc_id and its row, of rows or groups (digest, top_id, row)."""
    row = F.coalesce(F.max_by("row", "top_id"), F.max("row"))
    return groups.groupBy("digest").agg(F.sum(size).alias("group_size"), F.max("top_id").alias("top_id"), row.alias("row"))


def grouped(rows: DataFrame) -> DataFrame:
    """The written table of the groups of `digested` rows."""
    return common.written(merged(rows.withColumnRenamed("doc_id", "top_id"), F.lit(1)), "op13-groups")


def decided(rows: DataFrame, groups: DataFrame, index: DigestIndex, batches: Sequence[str]) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for each of the rows, whose groups were added in the named batches. Rows that are alone are read off their
    groups; the others meet theirs in a join that is broadcast or has its hot digests split."""
    known = common.written(index.known(groups).withColumn("fresh", F.col("batch").isin(*batches)), "op13-known")
    alone = known.where("group_size = 1").select(F.col("top_id").alias("doc_id"), "digest", "keep_id", "group_size", F.col("fresh").alias("kept"))
    several = known.where("group_size > 1").select("digest", "keep_id", "group_size", "fresh", F.col("row").alias("first"))
    met = rows.join(common.small_or_shuffled(several, BROADCAST_ROWS), "digest")
    return alone.unionByName(met.select("doc_id", "digest", "keep_id", "group_size", (F.col("fresh") & (F.col("row") == F.col("first"))).alias("kept")))


def deduplicated(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Adds `docs` to the index as one batch; what `decided` returns for them."""
    rows = digested(docs)
    groups = grouped(rows)
    index.add(groups, batch)
    return decided(rows, groups, index, [batch])


def filtered(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of `docs`, all columns, that stay when it is added to the index as one batch."""
    decisions = common.written(deduplicated(docs, index, batch), "op13-decisions")
    marked = docs.withColumn("_sm_digest", digest_of(docs["text"]))

    def meeting(keys: DataFrame, how: str, left: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_sm_id"), F.col("digest").alias("_sm_of"))
        return left.join(keys, left["doc_id"].eqNullSafe(keys["_sm_id"]) & (left["_sm_digest"] == keys["_sm_of"]), how)

    staying = meeting(decisions.where("kept"), "left_semi", marked)
    repeated = decisions.where("group_size > 1").groupBy("doc_id", "digest").agg(F.count("*").alias("times")).where("times > 1")
    repeated = common.small_or_shuffled(common.written(repeated.select("doc_id", "digest"), "op13-repeated"), BROADCAST_ROWS)
    once = meeting(repeated, "left_semi", staying).dropDuplicates(["doc_id", "_sm_digest"])
    return meeting(repeated, "left_anti", staying).unionByName(once).drop("_sm_digest")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` in two batches, the upper half of the ids first, so that the largest id of all stays."""
    rows = digested(common.load(spark, sf_dir, "documents"))
    middle = rows.agg(F.expr("CAST(floor(min(doc_id) / 2D + max(doc_id) / 2D) AS BIGINT)")).first()[0]
    upper = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    index = DigestIndex(spark, common.fresh_path(spark, "op13-index"))
    batches = {"upper": grouped(rows.where(upper)), "lower": grouped(rows.where(~upper))}
    for name, groups in batches.items():
        index.add(groups, name)
    groups = common.written(merged(batches["upper"].unionByName(batches["lower"]), F.col("group_size")), "op13-all-groups")
    out = decided(rows, groups, index, list(batches))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
