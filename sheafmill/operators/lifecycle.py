"""Changes of curated tables. A table isn't changed in place: each operation gives the new table, to be written by the caller."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafmill.functions import texts
from sheafmill.operators import model


def insert_or_ignore(base: DataFrame, rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """base with those rows whose key it doesn't have; of rows with one key the first by `order`."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    fresh = rows.withColumn("_first", first).where("_first = 1").drop("_first").join(base.select(*key), list(key), "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def content_deduped(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(sha256, id, n): one row a distinct content of a collection, the smallest id, without contents that are known by (collection, sha256)."""
    hashed = docs.withColumn("sha256", F.sha2("content", 256)).groupBy("collection", "sha256").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return hashed if known is None else hashed.join(known.select("collection", "sha256"), ["collection", "sha256"], "left_anti")


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the non-null fields of a patch row; an edited row loses `verified`."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields])
    out = base.join(p, base[key] == p["_key"], "left")
    given = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in fields else F.col(c)
    verified = F.when(F.coalesce(*[F.col(f"_{c}").cast("string") for c in fields]).isNotNull(), F.lit(False)).otherwise(F.col("verified"))
    return out.select(*[(verified if c == "verified" else given(c)).alias(c) for c in base.columns])


def verified(base: DataFrame, ids: DataFrame, key: str, by: str, at: Column) -> DataFrame:
    v = ids.select(F.col(key).alias("_key"), F.lit(True).alias("_v")).distinct()
    out = base.join(v, base[key] == v["_key"], "left")
    return out.select(*[base[c] for c in base.columns if c not in ("verified", "verified_by", "verified_at")], F.coalesce("_v", base["verified"]).alias("verified"), F.when(F.col("_v"), by).alias("verified_by"), F.when(F.col("_v"), at).alias("verified_at"))


def reviewed(chunks: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks after actions (id, action, content): accept, reject, or edit, which takes the new content, and its normal form, tokens, token count
    and language, and drops the embedding; an edit to a blank content is refused and changes nothing. Second, the embed jobs of the edits."""
    actions = actions.where("action <> 'edit' OR trim(content) <> ''")
    a = actions.select(F.col("id").alias("_id"), "action", F.col("content").alias("_content"))
    out = chunks.join(a, chunks["id"] == a["_id"], "left")
    state = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").when(F.col("action") == "edit", "edited").otherwise(F.col("review"))
    edit = F.coalesce(F.col("action") == "edit", F.lit(False))
    segmented = texts.segmented(F.col("_content"))
    fresh = {"content": F.col("_content"), "content_norm": texts.normalised(F.col("_content")), "content_seg": segmented["joined"], "token_count": segmented["count"], "lang": segmented["lang"]}
    changed = {c: F.when(edit, new.cast(chunks.schema[c].dataType)).otherwise(F.col(c)) for c, new in fresh.items() if c in chunks.columns}
    changed |= {"review": state, "embedding": F.when(~edit, F.col("embedding"))}
    jobs = actions.where("action = 'edit'").select("id", F.lit("embed").alias("job_type"))
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in chunks.columns]), jobs


def bulk_accepted(chunks: DataFrame, wanted: Column, over_tokens: int = 0) -> DataFrame:
    """Pending chunks that are wanted and longer than `over_tokens` are accepted."""
    hit = (F.col("review") == "pending") & wanted & (F.col("token_count") > over_tokens)
    return chunks.withColumn("review", F.when(hit, "accepted").otherwise(F.col("review")))


def cascade_deleted(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, references: DataFrame | None = None, reference: str = "") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Parents and children without the keys in `gone`; references to them become null."""
    keys = gone.select(key).distinct()
    refs = None
    if references is not None:
        marked = references.join(keys.select(F.col(key).alias("_gone")), F.col(reference) == F.col("_gone"), "left")
        refs = marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == reference else F.col(c) for c in references.columns])
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti"), refs


def documents_deleted(documents: DataFrame, chunks: DataFrame, jobs: DataFrame, gone: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (document), their chunks and their jobs without those in `gone`, and an audit event for each that was there."""
    keys = gone.select("document").distinct()
    deleted = documents.join(keys, "document", "left_semi")
    counts = chunks.join(keys, "document", "left_semi").groupBy("document").agg(F.count("*").alias("deleted_chunks"))
    told = deleted.select("document").join(counts, "document", "left").fillna(0, ["deleted_chunks"])
    events = model.audit(told, "document.deleted", at, "document", "deleted_chunks")
    return (*(x.join(keys, "document", "left_anti") for x in (documents, chunks, jobs)), events)


def citations_of_kinds(documents: DataFrame, chunks: DataFrame, qa: DataFrame) -> DataFrame:
    """(kind, documents, chunks, cited_qa, distinct_qa) by the kind of documents (document, kind) with chunks (id, document): how many question rows
    (qa_id, citations) cite them. `cited_qa` sums over documents, so a row that cites two of them counts twice."""
    per = chunks.join(documents, "document").select("kind", "document", "id")
    cites = qa.select("qa_id", F.explode(F.array_distinct("citations")).alias("id")).join(per, "id").select("kind", "document", "qa_id").distinct()
    cited = cites.groupBy("kind").agg(F.count("*").alias("cited_qa"), F.count_distinct("qa_id").alias("distinct_qa"))
    held = documents.join(chunks.groupBy("document").agg(F.count("*").alias("n")), "document", "left").groupBy("kind").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    return held.join(cited, "kind", "left").fillna(0, ["cited_qa", "distinct_qa"])


def kinds_deleted(documents: DataFrame, chunks: DataFrame, qa: DataFrame, kinds: DataFrame, at: Column, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents and chunks after all entries of some kinds (kind) are deleted, a report and audit events. A kind that any question cites
    is blocked, and stays, unless forced."""
    report = citations_of_kinds(documents, chunks, qa).join(kinds.select("kind").distinct(), "kind", "left_semi").withColumn("blocked", (F.col("cited_qa") > 0) & ~F.lit(force))
    gone = documents.join(report.where("NOT blocked").select("kind"), "kind", "left_semi").select("document")
    events = model.audit(report.where("NOT blocked AND documents > 0"), "knowledge.bulk_deleted", at, "kind", "documents", "chunks", "cited_qa")
    return documents.join(gone, "document", "left_anti"), chunks.join(gone, "document", "left_anti"), report, events


def purged_but(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Only the rows whose key is kept."""
    return rows.join(kept.select(key).distinct(), key, "left_semi")


def children_replaced(children: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    return children.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def json_merged(base: DataFrame, ids: DataFrame, key: str, column: str, field: str, value: object) -> DataFrame:
    """A field set in a JSON object column of the listed rows: `value` as JSON has it, a boolean, number, text, list or object. All other fields keep their types and
    what is nested in them. What is null or no object becomes one of that field."""
    m = ids.select(F.col(key).alias("_key")).distinct()
    out = base.join(m, base[key] == m["_key"], "left")
    parsed = F.coalesce(F.from_json(F.col(column), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    others = F.map_filter(parsed, lambda k, v: k != field)
    merged = F.to_json(F.map_concat(others, F.create_map(F.lit(field), F.parse_json(F.lit(json.dumps(value))))))
    return out.select(*[(F.when(F.col("_key").isNotNull(), merged).otherwise(F.col(c)) if c == column else F.col(c)).alias(c) for c in base.columns])


def retro_cleaned(chunks: DataFrame, defects: Column, fixed: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks with fixed contents where there are defects (their embeddings dropped, other columns as they were), a report by
    collection, and the documents to embed anew."""
    marked = chunks.withColumn("_n", defects)
    out = marked.withColumn("content", F.when(F.col("_n") > 0, fixed).otherwise(F.col("content"))).withColumn("embedding", F.when(F.col("_n") == 0, F.col("embedding")))
    report = marked.groupBy("collection").agg(F.sum("_n").alias("defects"), F.count_if(F.col("_n") > 0).alias("affected"))
    return out.select(*chunks.columns), report, marked.where("_n > 0").select("id").distinct()


def newest_kept(rows: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def fully_embedded(chunks: DataFrame) -> DataFrame:
    """Collections without a pending embedding."""
    return chunks.groupBy("collection").agg(F.count_if(F.col("embedding").isNull()).alias("left_over")).where("left_over = 0").select("collection")


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Chunks whose pending embeddings are set from vectors (key, vector), and (collection, status): `embedded` where none is pending any more."""
    found = vectors.select(F.col(key).alias("_key"), F.col("vector").alias("_vector"))
    out = chunks.join(found, chunks[key] == found["_key"], "left").withColumn("embedding", F.coalesce("embedding", "_vector")).select(*chunks.columns)
    status = F.when(F.count_if(F.col("embedding").isNull()) == 0, "embedded").otherwise("chunked")
    return out, out.groupBy("collection").agg(status.alias("status"), F.count("*").alias("n"))


def put(base: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects (key, content) added to a store by content key: what is there stays, whatever is put again."""
    return base.unionByName(objects.dropDuplicates(["key"]).join(base.select("key"), "key", "left_anti").select(*base.columns))
