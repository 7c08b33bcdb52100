"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: of pages with equal payloads the one of the smallest page_id is stored as a response record, the others as revisits
that refer to it. Records are rows of Spark's text writer, whose line separator is the blank line that ends a record; so
the files of the folder are plain WARC files, written by Spark's commit protocol. A file has at most `RECORDS_PER_FILE` records of
payloads of up to `LARGE` bytes, or one of a larger payload.

Reading: Spark's text source parts the files at version lines, range by range, so that no task holds a whole file. For each place where
a version line stands, a task emits a candidate with the offset of its successor (by its Content-Length). A payload may hold version
lines of its own; by pointer jumping from the file's start, doubling the step each round, only the candidates on the chain of
successors are kept. The chain has to end where the file ends, by the file's listing. Payloads are held against their digests, those with
version lines of their own after their pieces are put together, and revisits against the response that they name.

Defined cases: a null html is an empty payload; payloads of under `min_revisit_bytes` are never revisits; repeated rows of the
smallest page_id are all responses; a null page_id revisits a page that has one, and else is a response; null urls are left out; line
ends in urls become blanks, and urls may be of any length; no rows give no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import common

MAGIC = b"WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
LARGE, RECORDS_PER_FILE = 1 << 20, 512
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payload digests that stand in more than one page: 48 bytes a row; broadcast up to so many rows, shuffled beyond.
BROADCAST_ROWS = 50_000

HEADER = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PIECES = f"file string, file_bytes long, block long, at long, size long, length long, whole boolean, {HEADER}"
CHAINED = f"{PIECES}, start long, on_chain boolean, broken boolean"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record without its closing blank line."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC-Type: " + ("revisit" if refers_to is not None else "response"), f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    head += ["WARC-Payload-Digest: sha1:" + digest, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.when(F.length("payload") >= min_revisit_bytes, F.sha1("payload")))
    copies = rows.where("sha1 IS NOT NULL").groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha1", "first_id")
    rows = rows.join(common.small_or_shuffled(common.written(copies, "op9-copies"), BROADCAST_ROWS), "sha1", "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        for batch in batches:
            yield pd.DataFrame({"value": [record(whole(r.page_id), r.url, r.payload, whole(r.refers_to)) for r in batch.itertuples(index=False)]})

    def save(some: DataFrame, per_file: int) -> None:
        made = some.mapInPandas(records, "value binary").select(F.col("value").cast("string"))
        made.write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", per_file).text(path)

    is_large = F.length("payload") > LARGE
    any_large = pages.where(F.octet_length("html") > LARGE).limit(1).count() > 0
    save(rows.where(~is_large) if any_large else rows, RECORDS_PER_FILE)
    if any_large:
        save(rows.where(is_large), 1)


def candidate(piece: bytes) -> dict | None:
    """What a record says whose version line stands before `piece`: its length with that line, and whether the piece holds all of it.
    None if no header is there."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in piece[:end].split(b"\r\n"))}
    if not head.get(b"content-length", b"").isdigit():
        return None
    at, size = end + 4, int(head[b"content-length"])
    number = lambda k: int(m[1]) if (m := re.match(rb"<urn:x-page:(-?\d+):", head.get(k, b""))) else None
    out = {
        "length": len(MAGIC) + at + size + 4, "whole": piece[at + size : at + size + 4] == b"\r\n\r\n", "page_id": number(b"warc-record-id"), "refers_to": number(b"warc-refers-to"),
        "record_type": head.get(b"warc-type", b"").decode("ascii", "replace"), "payload_digest": head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace"), "payload_bytes": None}
    if not out["whole"]:
        return out
    http, _, payload = piece[at : at + size].partition(b"\r\n\r\n")
    if out["record_type"] == "revisit":
        stated = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        out["payload_bytes"] = int(stated[1]) if stated else None
    else:
        out["payload_bytes"] = len(payload)
        if payload_digest(payload) != out["payload_digest"]:
            out["payload_digest"] = None
    return out


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between version lines, with their file and range."""
    rows = spark.read.option("lineSep", MAGIC.decode()).text(path)
    of = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "file"), ("file_size", "file_bytes"), ("file_block_start", "block"))]
    return rows.select(*of, F.col("value").cast("binary").alias("piece"))


def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with `at`, their first byte's place behind that of their range's first row. Rows of a range come in order."""
    here, at = None, 0
    for batch in batches:
        sizes = batch["piece"].str.len().to_numpy(np.int64)
        places = np.zeros(len(batch), np.int64)
        for k, (of, size) in enumerate(zip(zip(batch["file"], batch["block"], strict=True), sizes.tolist(), strict=True)):
            here, at = of, 0 if of != here else at
            places[k] = at
            at += size + len(MAGIC)
        yield batch.assign(at=places, size=sizes)


def pieces(lines: DataFrame) -> DataFrame:
    """A row a piece, with what it says if it begins with a header."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in placed(batches):
            found = pd.DataFrame([candidate(p) or {} for p in batch["piece"]], columns=names[5:], dtype=object)
            yield pd.concat([batch.drop(columns="piece").reset_index(drop=True), found], axis=1)[names]

    return lines.mapInPandas(scan, PIECES)


def on_chain(starts: np.ndarray, successors: np.ndarray, file_bytes: int) -> np.ndarray:
    """Which candidates are reachable from offset 0, by pointer jumping."""
    order = np.argsort(starts)
    starts, n = starts[order], len(starts)
    at = np.searchsorted(starts, successors[order])
    jump = np.append(np.where((at < n) & (starts[np.minimum(at, n - 1)] == successors[order]), at, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and starts[0] == 0
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    reached = reached[:n]
    if file_bytes and (not reached.any() or successors[order][reached].max() != file_bytes):
        raise ValueError("the archive breaks off: its chain of records doesn't reach its end")
    out = np.zeros(n, bool)
    out[order] = reached
    return out


def chained(rows: pd.DataFrame) -> pd.DataFrame:
    """One file's pieces, some numbers each, with the records that they belong to."""
    rows = rows.sort_values(["block", "at"], kind="stable").reset_index(drop=True)
    first = np.cumsum(rows["size"].to_numpy(np.int64) + len(MAGIC)) - rows["size"].to_numpy(np.int64) - 2 * len(MAGIC)  # the version line before each piece
    said = rows["length"].notna().to_numpy() & (first >= 0)
    reached = np.zeros(len(rows), bool)
    reached[said] = on_chain(first[said], first[said] + rows["length"][said].to_numpy(np.int64), int(rows["file_bytes"].iloc[0]))
    if (rows["payload_digest"].isna() & rows["whole"].eq(True) & reached).any():
        raise ValueError("a payload differs from its digest")
    record_at = np.maximum.accumulate(np.where(reached, np.arange(len(rows)), 0))
    broken = rows["whole"].ne(True).to_numpy()[record_at] & reached[record_at]
    return rows.assign(start=first[record_at], on_chain=reached, broken=broken)


def put_together(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The records of several pieces: their payloads hold version lines. Pieces of one record meet in one group."""
    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "at"])
        said = candidate(MAGIC.join(rows["piece"]))
        if said is None or not said["whole"] or said["payload_digest"] is None:
            raise ValueError("a payload differs from its digest")
        return pd.DataFrame([{k.split()[0]: said[k.split()[0]] for k in HEADER.split(", ")}])

    keys = ["file", "block", "at"]
    with_place = lines.mapInPandas(lambda batches: (b[[*keys, "piece"]] for b in placed(batches)), "file string, block long, at long, piece binary")
    parts = with_place.join(common.small_or_shuffled(found.where("broken").select(*keys, "start"), BROADCAST_ROWS), keys)
    return parts.groupBy("file", "start").applyInPandas(joined, HEADER)


def verified(records: DataFrame) -> DataFrame:
    """`records`, which must be written, where each revisit has digest and length of the response that it names; else an error."""
    responses = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("found"))
    revisits = records.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left")
    right = F.when(F.col("found") == F.col("payload_bytes"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a revisit differs from its response")).cast("long"))
    names = [x.split()[0] for x in HEADER.split(", ")]
    return records.where("record_type <> 'revisit'").select(*names).unionByName(revisits.withColumn("payload_bytes", right).select(*names))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder. A group is one file's candidates, some numbers each."""
    lines, names = lines_of(spark, path), [x.split()[0] for x in HEADER.split(", ")]
    found = common.written(pieces(lines).groupBy("file").applyInPandas(chained, CHAINED), "op9-found")
    records = found.where("on_chain AND NOT broken").select(*names)
    if found.where("broken").limit(1).count():
        records = records.unionByName(put_together(lines, found))
        records = common.written(records, "op9-records")
    return verified(records)


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "op9-warc")
    write_archives(common.load(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
