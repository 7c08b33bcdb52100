"""Ingest of texts as one plan: content dedupe, parsing, cleaning, chunking, account rows, embed jobs and audit events."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafmill.functions import texts
from sheafmill.operators import chunking, lifecycle
from sheafmill.sources import markdown


class Ingested(NamedTuple):
    documents: DataFrame
    chunks: DataFrame
    jobs: DataFrame
    events: DataFrame


def ingested(docs: DataFrame, known: DataFrame | None = None, most: int = chunking.MAX_TOKENS, overlap: int = chunking.OVERLAP) -> Ingested:
    """From rows of (id, collection, content): new documents by content, their chunks (pending, without embeddings), embed jobs and events.
    Running it again with the first run's documents as `known` adds nothing."""
    fresh = lifecycle.content_deduped(docs, known)
    rows = docs.join(fresh.select("id", "sha256"), "id").select(F.col("id").alias("doc_id"), "collection", texts.defects_fixed(F.col("content")).alias("text"))
    made = chunking.block_chunks(markdown.markdown_blocks(rows), most, overlap)
    chunks = made.select("doc_id", "seq", "kind", "content", texts.squeezed(F.col("content")).alias("content_norm"), "token_count", texts.language(F.col("content")).alias("lang"), "path", F.lit("pending").alias("review"), F.lit(None).cast("array<float>").alias("embedding"))
    documents = fresh.select("id", "collection", "sha256", F.lit("chunked").alias("status"))
    jobs = documents.select("id", F.lit("embed").alias("job_type"), F.lit(0).alias("attempts"), F.lit("pending").alias("status"))
    events = documents.select("id", F.lit("document.chunked").alias("event_type"))
    return Ingested(documents, chunks, jobs, events)


class Saved(NamedTuple):
    """The tables after authored entries were saved, and what that sets off."""

    documents: DataFrame
    chunks: DataFrame
    jobs: DataFrame
    events: DataFrame


def entry_chunks(entries: DataFrame, most: int = chunking.MAX_TOKENS, overlap: int = chunking.OVERLAP) -> DataFrame:
    """The chunks of authored entries (id, title, body, kind, collection): whoever writes one has reviewed it, so they are accepted; their meta names the kind."""
    parsed = markdown.entry_blocks(entries, "id", "title", "body")
    block = F.struct("block_no", "kind", markdown.rendered(F.col("kind"), F.col("text")).alias("text"), "path")
    blocks = parsed.groupBy(F.col("id").alias("doc_id")).agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    blocks = blocks.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["path"].alias("path"))))
    made = chunking.block_chunks(blocks, most, overlap).join(entries.select(F.col("id").alias("doc_id"), "collection", F.col("kind").alias("_kind")), "doc_id")
    meta = F.to_json(F.struct(F.lit(True).alias("manual"), F.col("_kind").alias("knowledge_kind")))
    return made.select(
        "doc_id", "collection", "seq", "kind", "content", texts.defects_fixed(texts.normalised(F.col("content"))).alias("content_norm"), "token_count", texts.language(F.col("content")).alias("lang"), "path",
        F.lit("accepted").alias("review"), meta.alias("meta"), F.lit(None).cast("array<float>").alias("embedding"),
    )


def entries_saved(entries: DataFrame, documents: DataFrame, chunks: DataFrame) -> Saved:
    """Creates or updates entries (id, title, body, kind, collection) in documents (id, title, collection, meta) and chunks (as `entry_chunks` makes them): an updated
    entry's chunks are all replaced, and lose their vectors. An entry without any text has no chunk and no job, and keeps its row. Of several entries of one id, one must be
    chosen by the caller."""
    fresh = entry_chunks(entries)
    rows = entries.select("id", "title", "collection", F.to_json(F.struct(F.lit(True).alias("manual"), F.col("kind").alias("knowledge_kind"))).alias("meta"))
    kept = chunks.join(entries.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(*fresh.columns)
    known = documents.select("id", F.lit(True).alias("known"))
    told = F.when(F.col("known"), "knowledge.updated").otherwise("knowledge.created")
    jobs = fresh.select(F.col("doc_id").alias("id")).distinct().select("id", F.lit("embed").alias("job_type"), F.lit(0).alias("attempts"), F.lit("queued").alias("status"))
    return Saved(lifecycle.children_replaced(documents.select(*rows.columns), rows, "id"), kept.unionByName(fresh), jobs, entries.select("id").join(known, "id", "left").select("id", told.alias("event_type")))


def previewed(docs: DataFrame) -> DataFrame:
    """What an ingest would find in each document, without writing: chunks, tokens, tables, defects."""
    made = ingested(docs)
    per = made.chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if(F.col("kind") == "table").alias("tables"))
    return docs.select(F.col("id").alias("doc_id"), texts.defect_counts(F.col("content"))["total"].alias("defects")).join(per, "doc_id", "left").fillna(0, ["chunks", "tokens", "tables"])
