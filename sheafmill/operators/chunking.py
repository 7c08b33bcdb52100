"""Packing of sentences or typed blocks into chunks of bounded token counts, with overlap."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sheafmill.functions import batches, texts

MAX_TOKENS, OVERLAP = 400, 60


def blank_parted(found: Column) -> Column:
    """How many blank-parted tokens each text of an array has; `segmentation.counts` is the form for texts without blanks."""
    return F.transform(found, lambda t: F.size(texts.tokens(t)))


def checked(most: int, overlap: int) -> None:
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("most must be positive, and overlap from 0 to under it")


def back_from(sums: list[int], low: int, high: int, overlap: int) -> int:
    """Where the next chunk begins: the last place whose tail up to `high` reaches the overlap, but after `low`."""
    return max(low + 1, bisect_right(sums, sums[high] - overlap) - 1) if overlap > 0 else high


def sentence_spans(counts: list[int], most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of sentences: as many as fit, one at least; each next one steps back by the overlap."""
    checked(most, overlap)
    sums, spans, low = [0, *accumulate(counts)], [], 0
    while low < len(counts):
        high = max(low + 1, bisect_right(sums, sums[low] + most) - 1)
        spans.append((low, high))
        low = back_from(sums, low, high, overlap) if high < len(counts) else high
    return spans


def block_spans(counts: list[int], most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of prose blocks of one heading: a block that would overflow opens a new span behind the carried overlap, and is always taken."""
    sums, spans, low = [0, *accumulate(counts)], [], 0
    for i in range(len(counts)):
        if i > low and sums[i + 1] - sums[low] > most:
            spans.append((low, i))
            low = back_from(sums, low, i, overlap)
    return [*spans, (low, len(counts))] if counts else []


def chunked_blocks(blocks: list[dict], most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of ordered blocks (kind, text, tokens, path): headings part, tables and account rows stand alone whole, prose and lists of one
    path are packed as prose. Later meta entries win."""
    out = []
    runs = groupby(enumerate(blocks), key=lambda b: (b[1]["kind"] if b[1]["kind"] in ("heading", "table", "account_row") else "prose", tuple(b[1]["path"]), b[0] if b[1]["kind"] != "prose" and b[1]["kind"] != "list" else -1))
    for (kind, path, _), run in runs:
        group = [b for _, b in run]
        if kind == "heading":
            continue
        for low, high in [(0, 1)] if kind != "prose" else block_spans([b["tokens"] for b in group], most, overlap):
            part = group[low:high]
            out.append({"seq": len(out), "kind": kind, "content": "\n".join(b["text"] for b in part), "token_count": sum(b["tokens"] for b in part), "path": list(path), "meta": {k: v for b in part for k, v in (b.get("meta") or {}).items()}})
    return out


def packed(rows: DataFrame, pack: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `pack` makes of each row; a small part of a batch is Python objects at a time."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def made(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in batches.parts(batch):
                out = [row for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for row in pack(*values)]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind.type) for i, kind in enumerate(kinds)], schema=kinds)

    return rows.mapInArrow(made, schema)


def sentence_chunks(docs: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, counts: Callable[[Column], Column] = blank_parted) -> DataFrame:
    """(doc_id, seq, content, token_count, n_sentences). Sentences and token counts are native; packing runs inside a row."""
    checked(most, overlap)
    found = texts.sentences(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", found.alias("sentences")).withColumn("counts", counts(F.col("sentences")))

    def pack(doc_id: int, sentences: list[str], counts: list[int]) -> Iterator[tuple]:
        for seq, (a, b) in enumerate(sentence_spans(counts, most, overlap)):
            yield doc_id, seq, " ".join(sentences[a:b]), sum(counts[a:b]), b - a

    return packed(rows, pack, "doc_id long, seq long, content string, token_count long, n_sentences long")


def block_chunks(documents: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, counts: Callable[[Column], Column] = blank_parted) -> DataFrame:
    """(doc_id, seq, kind, content, token_count, path) from rows of (doc_id, blocks), blocks being an array of structs of kind, text, path."""
    fields = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["path"].alias("path")))
    # blocks and counts meet in `pack`: a lambda over the blocks that looks up its count makes all counts anew for each block, as the optimizer puts them into it
    counted = documents.select("doc_id", fields.alias("blocks"), counts(F.transform("blocks", lambda b: b["text"])).alias("counts"))

    def pack(doc_id: int, blocks: list[dict], counts: list[int]) -> Iterator[tuple]:
        for c in chunked_blocks([{**b, "tokens": n} for b, n in zip(blocks, counts, strict=True)], most, overlap):
            yield doc_id, c["seq"], c["kind"], c["content"], c["token_count"], c["path"]

    return packed(counted, pack, "doc_id long, seq long, kind string, content string, token_count long, path array<string>")
