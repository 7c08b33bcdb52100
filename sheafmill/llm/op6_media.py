"""Media columns with content-defined chunks.

A text's payload is kept as an 8-bit mono WAV. A rolling gear hash over the last 32 bytes cuts the file where its top bits are
zero, between the least and the greatest chunk size, so equal passages give equal chunks wherever they stand. Chunks are
named by SHA-256; a chunk that occurs twice or more in the corpus goes once into the chunk table, any other stays in
its file's row, and the row's ordered chunk list rebuilds the file by a join. Every chunk and file is verified by digest.

Which chunks recur is found by a shuffle of digests alone, with the text and place that first have each. Joined back by text, this tells
the writer of a file which places are shared, and which of them it has to give to the chunk table; lone chunks stay in their rows.

Defined cases: null and empty texts have a payload of 192 blanks; equal texts give equal values, whatever else stands in their
rows; repeated rows are returned each; no rows give none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common

PAD_TO, RATE = 192, 8000
LEAST, MOST, CUT_BITS = 256, 8192, 11
GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Rows of rebuilt values (about 300 bytes each) and of texts' shared places (40 bytes, and 9 a place, measured); broadcast up to so many,
#: shuffled beyond.
BROADCAST_ROWS, BROADCAST_TEXTS = 10_000, 200_000

MEDIA = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, digests array<binary>, sizes array<int>, shared array<boolean>, own binary, given array<struct<digest: binary, chunk: binary>>"
VALUES = "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def payload_of(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + b" " * (max(PAD_TO, -(-len(raw) // PAD_TO) * PAD_TO) - len(raw))


def wav(payload: bytes) -> bytes:
    form = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(payload), b"WAVE") + form + payload


def samples(media: bytes) -> bytes:
    size = struct.unpack_from("<I", media, 40)[0]
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or len(media) != 44 + size:
        raise ValueError("not a WAV file as this module writes it")
    return media[44:]


def cut(media: bytes) -> list[bytes]:
    """The chunks of a file."""
    rolled = GEAR[np.frombuffer(media, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # the hash of the last 2 * step bytes from those of the last step bytes
        wider = rolled.copy()
        wider[step:] += rolled[:-step] << np.uint32(step)
        rolled = wider
    places = np.nonzero(rolled >> np.uint32(32 - CUT_BITS) == 0)[0] + 1
    out, begin = [], 0
    while begin < len(media):
        k = int(np.searchsorted(places, begin + LEAST))
        end = min(int(places[k]) if k < len(places) else len(media), begin + MOST, len(media))
        out.append(media[begin:end])
        begin = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def shared_places(texts: DataFrame) -> DataFrame:
    """(key, places) of the texts that have chunks which occur twice or more in the corpus: place by place, and whether the text is the one
    that gives it to the chunk table. A digest's texts are aggregated before the shuffle."""
    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "digests": [[digest(c) for c in cut(wav(payload_of(t)))] for t in batch["text"]]})

    cuts = common.written(texts.select("key", "text").mapInPandas(names, "key binary, digests array<binary>"), "op6-cuts")
    chunks = cuts.select("key", F.posexplode("digests").alias("place", "digest"))
    recurring = chunks.groupBy("digest").agg(F.min(F.struct("key", "place")).alias("giver"), F.count("*").alias("n")).where("n > 1").select("digest", "giver")
    once = cuts.groupBy("key").agg(F.first("digests").alias("digests")).select("key", F.posexplode("digests").alias("place", "digest"))
    found = once.join(common.written(recurring, "op6-recurring"), "digest")
    gives = (F.col("giver.key") == F.col("key")) & (F.col("giver.place") == F.col("place"))
    return common.written(found.groupBy("key").agg(F.collect_list(F.struct("place", gives.alias("gives"))).alias("places")), "op6-places")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunks): a written row a document, and a row a recurring chunk."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    texts = texts.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit(b"")), 256)))

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, places in zip(batch["doc_id"], batch["text"], batch["places"], strict=True):
                gives = {int(x["place"]): bool(x["gives"]) for x in places} if places is not None else {}
                media = wav(payload_of(text))
                chunks = cut(media)
                names = [digest(c) for c in chunks]
                own = b"".join(c for k, c in enumerate(chunks) if k not in gives)
                given = [{"digest": names[k], "chunk": chunks[k]} for k, mine in gives.items() if mine]
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(text or b""), len(media), hashlib.sha256(media).hexdigest(), names, [len(c) for c in chunks], [k in gives for k in range(len(chunks))], own, given))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "media_bytes", "media_sha256", "digests", "sizes", "shared", "own", "given"], dtype=object).astype({"doc_id": "Int64", "n_bytes": "Int64", "media_bytes": "Int64"})

    places = common.small_or_shuffled(shared_places(texts), BROADCAST_TEXTS, 40 + 9 * F.size("places"))
    kept = common.written(texts.join(places, "key", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "places").mapInPandas(files, MEDIA), "op6-files")
    given = kept.where(F.size("given") > 0).select(F.explode("given").alias("x")).select("x.*")
    return kept.drop("given"), given.dropDuplicates(["digest"])


def feature(payload: bytes) -> str:
    heard = np.frombuffer(payload, np.uint8).astype(np.int64)
    high = heard >= 96
    return f"mean={int(heard.sum()) * 100 // len(heard)};peak={heard.max()};low={heard.min()};crossings={int((high[1:] != high[:-1]).sum())}"


def whole_ids(ids: pd.Series) -> pd.Series:
    """Ids from their texts: beside a null, pandas would round numbers to doubles."""
    return pd.Series([None if pd.isna(i) else int(i) for i in ids], dtype="Int64")


def values(rows: pd.DataFrame) -> pd.DataFrame:
    """Rebuilds, verifies and reads the files of some rows: media_sha256, digests, sizes, shared, own, and borrowed chunks by place."""
    out = []
    for row in rows.itertuples(index=False):
        borrowed = {int(x["place"]): bytes(x["chunk"]) for x in row.borrowed} if row.borrowed is not None else {}
        parts, at = [], 0
        for k, (name, size, shared) in enumerate(zip(row.digests, row.sizes, row.shared, strict=True)):
            part = borrowed[k] if shared else row.own[at : at + size]
            at += 0 if shared else size
            if digest(part) != bytes(name):
                raise ValueError("a chunk differs from its digest")
            parts.append(part)
        media = b"".join(parts)
        if hashlib.sha256(media).hexdigest() != row.media_sha256:
            raise ValueError("a rebuilt file differs from its digest")
        payload = samples(media)
        out.append((row.media_sha256, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature(payload)))
    return pd.DataFrame(out, columns=["media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def read_back(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a row of `files` with the values read from the rebuilt files. A file that copies share is rebuilt once."""
    has_shared = F.exists("shared", lambda s: s)
    rebuilt = lambda batches: (values(b) for b in batches)
    body = ["media_sha256", "digests", "sizes", "shared", "own"]
    whole = files.where(~has_shared).withColumn("borrowed", F.expr("CAST(NULL AS array<struct<place: int, chunk: binary>>)"))
    direct = whole.select(F.col("doc_id").cast("string").alias("doc_id"), "n_bytes", "media_bytes", *body, "borrowed").mapInPandas(
        lambda batches: (b[["doc_id", "n_bytes", "media_bytes"]].reset_index(drop=True).assign(doc_id=whole_ids(b["doc_id"])).join(values(b)) for b in batches), "doc_id long, n_bytes long, media_bytes long, " + VALUES)

    mixed = files.where(has_shared)
    once = mixed.select(*body).dropDuplicates(["media_sha256"])
    places = once.select("media_sha256", F.posexplode(F.arrays_zip("digests", "shared")).alias("place", "of")).where("of.shared").select("media_sha256", "place", F.col("of.digests").alias("digest"))
    lists = places.join(chunks, "digest").groupBy("media_sha256").agg(F.collect_list(F.struct("place", "chunk")).alias("borrowed"))
    read = common.written(once.join(lists, "media_sha256").select(*body, "borrowed").mapInPandas(rebuilt, VALUES), "op6-values")
    copies = mixed.select("doc_id", "n_bytes", "media_bytes", "media_sha256").join(common.small_or_shuffled(read, BROADCAST_ROWS), "media_sha256")
    return direct.unionByName(copies)


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks = store(common.load(spark, sf_dir, "documents"))
    return read_back(files, chunks).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
