"""Versioned dataset export: sorted JSONL files by split, with hashes and a manifest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafmill.operators import ordering
from sheafmill.sources import shared

#: A part is read back whole to be verified.
PART_BYTES = 64 << 20
VERSION = re.compile(r"\d+\.\d+\.\d+")


def checked_version(version: str) -> str:
    if not VERSION.fullmatch(version):
        raise ValueError(f"not a version: {version}")
    return version


def exportable(chunks: DataFrame, shareable: bool) -> DataFrame:
    """Accepted and edited chunks; without confidential ones if the export is to be shared."""
    live = chunks.where(F.col("review").isin("accepted", "edited"))
    return live.where("license <> 'client-confidential'") if shareable else live


def lines(rows: DataFrame, columns: list[str], split: Column | None = None, order: str = "id") -> DataFrame:
    """(file, order key, line): a JSON object a row; rows without a split go to train."""
    return rows.select(F.coalesce(split if split is not None else F.lit("train"), F.lit("train")).alias("file"), F.col(order).alias("id"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


def parted(written: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Lines (file, id, line) with their part: a file begins a new one where it has `part_bytes` behind it, so that no task writes or digests more than
    that and a line. Ids are told apart within a file."""
    sized = written.select("file", "id", "line", (F.octet_length("line") + 1).cast("long").alias("bytes"))
    return ordering.with_offsets(sized, ["file"], ["id"], "bytes").withColumn("part", F.floor(F.col("_before") / part_bytes)).drop("_before", "_weight")


def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (file, part, line), a part's in order and side by side, as a row a part with the digest of its bytes. No part is held."""
    at, state, records, size, out = None, None, 0, 0, []
    for batch in batches:
        for file, part, line in zip(batch["file"], batch["part"], batch["line"], strict=True):
            if (file, part) != at:
                out += [(*at, records, size, state.hexdigest())] if at else []
                at, state, records, size = (file, part), hashlib.sha256(), 0, 0
            raw = line.encode() + b"\n"
            state.update(raw)
            records, size = records + 1, size + len(raw)
        yield pd.DataFrame(out, columns=["file", "part", "records", "bytes", "sha256"])
        out = []
    if at:
        yield pd.DataFrame([(*at, records, size, state.hexdigest())], columns=["file", "part", "records", "bytes", "sha256"])


def by_part(parts: DataFrame) -> DataFrame:
    """Lines of `parted`, each part in one task and in order."""
    return parts.repartition("file", "part").sortWithinPartitions("file", "part", "id")


def manifest(written: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(file, part, records, bytes, sha256): what `write` makes of the lines (file, id, line), the digest being that of a part's bytes."""
    return by_part(parted(written, part_bytes)).select("file", "part", "line").mapInPandas(digested, "file string, part long, records long, bytes long, sha256 string")


def write(written: DataFrame, path: str, version: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """JSONL files, sorted by id and one a part, in a new folder of the version; a version that is there isn't written again. The manifest of what was written,
    whose digests are those of the files as they are read back; a file that differs is an error."""
    folder = f"{path}/{checked_version(version)}"
    parts = shared.written(parted(written, part_bytes), "export-lines")
    by_part(parts).select("file", "part", F.col("line").alias("value")).write.mode("error").partitionBy("file", "part").text(folder)
    made = shared.written(by_part(parts).select("file", "part", "line").mapInPandas(digested, "file string, part long, records long, bytes long, sha256 string"), "export-manifest")
    read = made.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    place = [F.regexp_extract("path", f"/{k}=([^/]*)/", 1) for k in ("file", "part")]
    read = read.select(F.url_decode(place[0]).alias("file"), place[1].cast("long").alias("part"), F.sha2("content", 256).alias("found"))
    wrong = made.join(read, ["file", "part"], "full").where("sha256 IS NULL OR found IS NULL OR sha256 <> found").limit(1).collect()
    if wrong:
        raise OSError(f"a file differs from what was written: {wrong[0]['file']}, part {wrong[0]['part']}")
    return made


def messages(qa: DataFrame) -> DataFrame:
    """Chat-form training rows of question and answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return qa.withColumn("messages", F.array(turn("user", "question"), turn("assistant", "answer")))


def licenses(chunks: DataFrame) -> DataFrame:
    return chunks.select("license").distinct().orderBy("license")


def newest_version(rows: DataFrame) -> DataFrame:
    """The newest row a file by version numbers."""
    parts = F.transform(F.split("version", "\\."), lambda x: x.cast("int"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy(F.desc(parts)))).where("_k = 1").drop("_k")


def data_card(files: DataFrame, chunks: DataFrame, version: str) -> DataFrame:
    """(place, line) of a dataset's card, from its manifest and its chunks: some lines, whatever the dataset's size."""
    per = files.select(F.concat(F.lit("1/"), "file", F.lit("/"), F.col("part").cast("string")).alias("place"), F.concat(F.lit("| "), "file", F.lit(" | "), F.col("records").cast("string"), F.lit(" | "), F.col("bytes").cast("string"), F.lit(" | "), "sha256", F.lit(" |")).alias("line"))
    told = chunks.groupBy(F.coalesce("license", F.lit("internal")).alias("license")).agg(F.count("*").alias("n"))
    per_license = told.select(F.concat(F.lit("3/"), "license").alias("place"), F.concat(F.lit("- "), "license", F.lit(": "), F.col("n").cast("string"), F.lit(" chunks")).alias("line"))
    fixed = [("0", f"# Data card, version {checked_version(version)}"), ("1", "| file | records | bytes | sha256 |"), ("2", "Licenses of the sources:")]
    return files.sparkSession.createDataFrame(fixed, "place string, line string").unionByName(per).unionByName(per_license)
