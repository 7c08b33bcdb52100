"""Schemas of the curated tables, and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENANT = "hf_id string, company_id string"
SCHEMAS = {
    "document": f"id string, {TENANT}, collection string, title string, sha256 string, lang string, license string, status string, superseded_by string, effective_date date, meta string, created_at timestamp",
    "chunk": f"id string, {TENANT}, document_id string, seq int, kind string, content string, content_norm string, content_seg string, token_count int, lang string, heading_path array<string>, review string, embedding array<float>, meta string, created_at timestamp",
    "account": f"id string, {TENANT}, code string, name_lo string, name_en string, parent_code string, account_class string, normal_balance string, statement string, verified boolean, source_chunk_id string",
    "term": f"id string, {TENANT}, term_lo string, term_en string, domain string, variants_lo array<string>, forbidden_lo array<string>, verified boolean, source_chunk_id string",
    "qa_pair": f"id string, {TENANT}, question string, answer string, citation_ids array<string>, tags array<string>, difficulty int, verified boolean, split string, source string",
    "eval_run": f"id string, {TENANT}, retriever string, params string, recall_5 decimal(5,4), recall_10 decimal(5,4), mrr decimal(5,4), p95_ms int, created_at timestamp",
    "eval_result": "id string, run_id string, qa_id string, hit_ids array<string>, hit_rank int, latency_ms int",
    "job": f"id string, {TENANT}, job_type string, payload string, status string, attempts int, max_attempts int, run_after timestamp, locked_at timestamp, last_error string",
    "event": f"id string, {TENANT}, event_type string, payload string, created_at timestamp, published_at timestamp",
    "conversation": f"id string, {TENANT}, title string, created_at timestamp, updated_at timestamp",
    "message": "id string, conversation_id string, role string, text string, sources string, meta string, created_at timestamp",
    "kind": f"id string, {TENANT}, key string, name_lo string, name_en string",
}
EVENTS = ("document.chunked", "corpus.retro_cleaned", "document.deleted", "knowledge.created", "knowledge.updated", "knowledge.bulk_deleted", "conversation.created", "message.created")


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a table's columns and types; absent ones are null, what can't be cast is null."""
    fields = [f.rsplit(" ", 1) for f in split_fields(SCHEMAS[name])]
    return rows.select(*[(F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in fields])


def split_fields(schema: str) -> list[str]:
    """Fields of a schema text; commas inside brackets belong to a type."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def audit(rows: DataFrame, event_type: str, at: Column, *payload: str) -> DataFrame:
    """Audit events of some rows; ids are hashes of type and payload, so a repeat appends the same rows."""
    if event_type not in EVENTS:
        raise ValueError(f"not an event type: {event_type}")
    body = F.to_json(F.struct(*payload))
    return rows.select(F.sha2(F.concat_ws("|", F.lit(event_type), body), 256).alias("id"), F.lit(event_type).alias("event_type"), body.alias("payload"), at.alias("created_at"))


def storage_key(kind: Column, sha256: Column, name: Column) -> Column:
    """Path of an object by its content."""
    return F.concat_ws("/", kind, F.substring(sha256, 1, 2), sha256, F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"))


def path_escapes(key: Column) -> Column:
    """Whether a key would leave its folder."""
    return key.startswith("/") | F.exists(F.split(key, "/"), lambda p: p == "..")


def with_recency(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their last message's time as `updated_at`, newest first."""
    last = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("last"))
    return conversations.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "last")).drop("last").orderBy(F.desc("updated_at"), "id")


def messages_added(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations with their recency, all messages, and an audit event for each new one (conversation_id, role, created_at ...)."""
    added = messages.unionByName(new.select(*messages.columns))
    return with_recency(conversations, new), added, audit(new, "message.created", F.col("created_at"), "conversation_id", "role", "created_at")


def ancestors(accounts: DataFrame, most: int = 12) -> DataFrame:
    """(code, ancestors): the chain of parent codes, nearest first, by one self join a level."""
    parents = accounts.select(F.col("code").alias("_c"), F.col("parent_code").alias("_p"))
    out = accounts.select("code", F.col("parent_code").alias("_up"), F.when(F.col("parent_code").isNotNull(), F.array("parent_code")).otherwise(F.array().cast("array<string>")).alias("ancestors"))
    for _ in range(most):
        out = out.join(parents, F.col("_up") == F.col("_c"), "left").select("code", F.col("_p").alias("_up"), F.when(F.col("_p").isNotNull() & ~F.array_contains("ancestors", F.col("_p")), F.array_append("ancestors", F.col("_p"))).otherwise(F.col("ancestors")).alias("ancestors"))
    return out.select("code", "ancestors")
