"""Streams that remember: retries by timers, lines and frames across cut chunks, resumable batches, and a stop at a batch's end.

State is Spark's: keyed, kept with the checkpoint, and the same after a restart. Each processor takes rows of one key at a time, and keeps of a key what it
needs and no more.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheafmill.operators import ordering
from sheafmill.sources import shared
from sheafmill.streaming import queue

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRIED = "job_id long, attempt int, status string, wait_seconds double, error string"
LINES = "stream_id string, n long, line string"
#: Chunks that come early are kept in blocks of so many places: a call to the state a block, not a chunk.
EARLY_BLOCK = 256
#: Batches of resumable work that are made at a time; they are put in place one after the other.
AT_ONCE = 8


def state_store(spark: SparkSession) -> None:
    """The state store that these processors need, for queries of this session that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class Retrying(StatefulProcessor):
    """Runs each job once it comes, and again after base * 2 ^ n seconds when it has failed n times, until it succeeds or has failed `most` times. A job that comes
    again is not run again. Emits a row an attempt: done, queued (with its wait) or failed."""

    def __init__(self, run: Callable[[int, str, int], Any], most: int = queue.MAX_ATTEMPTS, base: float = queue.BASE_SECONDS):
        self.run, self.most, self.base = run, most, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", "payload string, failures int, ended boolean")

    def attempted(self, job_id: int, payload: str, failures: int, now: int) -> pd.DataFrame:
        error, wait = None, None
        try:
            self.run(job_id, payload, failures)
        except Exception as why:  # noqa: BLE001 — whatever fails a job is its error
            error, failures = str(why), failures + 1
        status = "done" if error is None else "failed" if failures >= self.most else "queued"
        if status == "queued":
            wait = self.base * 2**failures
            self.handle.registerTimer(now + int(1000 * wait))
        self.job.update((payload if status == "queued" else None, failures, status != "queued"))
        attempt = failures + (error is None)
        return pd.DataFrame({"job_id": [job_id], "attempt": [attempt], "status": [status], "wait_seconds": [wait], "error": [error]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        payload = next((p for batch in rows for p in batch["payload"]), None)
        if not self.job.exists():
            yield self.attempted(key[0], payload, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        payload, failures, ended = self.job.get()
        if not ended:
            yield self.attempted(key[0], payload, failures, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def retried(jobs: DataFrame, run: Callable[[int, str, int], Any], most: int = queue.MAX_ATTEMPTS, base: float = queue.BASE_SECONDS) -> DataFrame:
    """The attempts (TRIED) of a stream of jobs (job_id, payload). `run` gets job_id, payload and the number of failures so far; it may run a second time for an
    attempt whose batch is repeated after a crash."""
    rows = jobs.select(F.col("job_id").cast("long").alias("job_id"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy("job_id").transformWithStateInPandas(Retrying(run, most, base), TRIED, "Append", "ProcessingTime")


class Pieced(StatefulProcessor):
    """Puts a stream's chunks (seq from 0 on, chunk) in order and parts their bytes at a mark, wherever the cuts are. Chunks that come early wait, in blocks of
    `EARLY_BLOCK` places, of which those alone are read and written that chunks come to; those that come again are left out. What follows the last mark waits for
    the next chunk."""

    def __init__(self, mark: bytes):
        self.mark = mark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, n long, tail binary, waiting long")
        self.early = handle.getMapState("early", "block long", "seqs array<long>, chunks array<binary>")

    def block(self, number: int) -> dict[int, bytes] | None:
        """The chunks that wait in a block, by their places; none, if there is no such block."""
        found = self.early.getValue((number,))
        return None if found is None else {seq: bytes(chunk) for seq, chunk in zip(*found, strict=True)}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        expected, n, tail, waiting = self.at.get() or (0, 0, b"", 0)
        blocks: dict[int, dict[int, bytes]] = {}
        stored: set[int] = set()

        def opened(number: int) -> dict[int, bytes]:
            if number not in blocks:
                found = self.block(number) if waiting else None
                stored.update(() if found is None else (number,))
                blocks[number] = found or {}
            return blocks[number]

        for row in rows:
            if row["seq"] >= expected:
                opened(row["seq"] // EARLY_BLOCK)[row["seq"]] = bytes(row["chunk"] or b"")
        ready = []
        while blocks and (chunk := opened(expected // EARLY_BLOCK).pop(expected, None)) is not None:
            ready.append(chunk)
            expected += 1
        for number, held in blocks.items():
            if held:
                self.early.updateValue((number,), (list(held), list(held.values())))
                waiting += number not in stored
            elif number in stored:
                self.early.removeKey((number,))
                waiting -= 1
        *whole, tail = (bytes(tail) + b"".join(ready)).split(self.mark)
        self.at.update((expected, n + len(whole), tail, waiting))
        for line in whole:
            yield Row(stream_id=key[0], n=n, line=line.decode("utf-8", "replace"))
            n += 1

    def close(self) -> None:
        pass


def pieced(chunks: DataFrame, mark: str = "\n") -> DataFrame:
    """(stream_id, n, line): the lines of streams that come as chunks (stream_id, seq, chunk) of bytes, cut anywhere; with a mark of two line ends, their frames."""
    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    return rows.groupBy("stream_id").transformWithState(Pieced(mark.encode()), LINES, "Append", "None")


def frames_of(pieces: DataFrame) -> DataFrame:
    """(stream_id, n, event) of frames (stream_id, n, line): the first data line of each, which is a JSON object."""
    data = F.regexp_extract("line", "(?m)^data: ?(.*)$", 1)
    return pieces.where(data != "").select("stream_id", "n", F.from_json(data, "map<string,string>").alias("event"))


def collected(stream: DataFrame, path: str, checkpoint: str, until: Callable[[], bool] | None = None, every: str = "200 milliseconds", most_seconds: int = 120) -> None:
    """Runs a stream into the Parquet table at `path`: what is there, or, with `until`, batch after batch (so that timers fall due) until it says so."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if until is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.trigger(processingTime=every).start()
    try:
        for _ in range(most_seconds * 5):
            if query.awaitTermination(0.2) or until():
                return
        raise TimeoutError(f"the stream did not come to its end within {most_seconds} s")
    finally:
        query.stop()


# ---- resumable work


def resumed(rows: DataFrame, of: Callable[[list], list], path: str, kind: str, size: int = 128, key: str = "id", column: str = "content", on_batch: Callable[[int, int], None] | None = None) -> DataFrame:
    """The table (key, value) at `path`, with a value of every row of `rows` (key, column) that lacks one. Work goes by batches of `size` rows in order of the key;
    each is written whole, and put in its place under its first key behind the ones before it, so that a run that is killed goes on behind the last whole batch, and one that repeats a batch
    replaces it. Rows are dealt to their batches once, so that a batch reads its own alone. `of` makes values of lists of texts (null as empty). `on_batch` hears what is done and how much is left. Null keys have no place in the order
    and are left out; repeated keys share one value."""
    spark, values = rows.sparkSession, f"{key} long, value {kind}, batch long"
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.coalesce(F.col(column), F.lit("")).alias(column))

    def table() -> DataFrame:
        return spark.read.schema(values).option("basePath", path).parquet(path)

    written = shared.exists(spark, path)
    done = table().count() if written else 0
    last = table().agg(F.max(key)).first()[0] if written else None
    dealt, spans = in_batches(rows if last is None else rows.where(F.col(key) > last), size, key)
    left = sum(n for _, _, n in spans)

    def make(number: int, low: int) -> str:
        part, staged = spark.read.schema(rows.schema).parquet(f"{dealt}/_batch={number}"), f"{path}/_staged-{low}"
        queue.mapped_in_batches(part, of, column, "value", kind).select(key, "value").write.mode("overwrite").parquet(staged)
        return staged

    with ThreadPoolExecutor(AT_ONCE) as pool:
        try:
            ahead = iter(spans)
            made = deque((span, pool.submit(make, *span[:2])) for span in islice(ahead, AT_ONCE))
            while made:
                (_, low, n), staged = made.popleft()
                shared.moved(spark, staged.result(), f"{path}/batch={low}")
                made.extend((span, pool.submit(make, *span[:2])) for span in islice(ahead, 1))
                done, left = done + n, left - n
                if on_batch:
                    on_batch(done, left)
        finally:
            pool.shutdown(cancel_futures=True)
    shared.deleted(spark, dealt)
    return table().drop("batch") if shared.exists(spark, path) else spark.createDataFrame([], f"{key} long, value {kind}")


def in_batches(rows: DataFrame, size: int, key: str) -> tuple[str, list[tuple[int, int, int]]]:
    """Where rows lie dealt to batches of `size` keys in order, a folder each, all in one pass; and each batch's number, first key, and number of keys."""
    placed = ordering.numbered(rows.select(key).distinct(), [], [key], "_batch").withColumn("_batch", F.floor((F.col("_batch") - 1) / size))
    placed = shared.written(placed, "batch-places")
    path = shared.fresh_path(rows.sparkSession, "batches")
    rows.dropDuplicates([key]).join(placed, key).repartitionByRange("_batch", key).write.partitionBy("_batch").parquet(path)
    spans = placed.groupBy("_batch").agg(F.min(key), F.count("*")).orderBy("_batch").collect()  # a row a batch
    return path, [tuple(r) for r in spans]


# ---- cancellation


class Stopped(Exception):
    """Raised between two batches of a stream that was asked to stop."""


class Stop:
    """A wish to stop, at a path that all see. Made by `ask`, taken back by `clear`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def ask(self) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self.path)

    def clear(self) -> None:
        shared.deleted(self.spark, self.path)

    def asked(self) -> bool:
        return shared.exists(self.spark, f"{self.path}/_SUCCESS")


def until_stopped(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, stop: Stop) -> bool:
    """Runs what is there through `handle` as `queue.processed` does, and ends before the next batch once `stop` is asked. Batches that were handled stay handled;
    a later run goes on with the first that wasn't. Whether all was handled."""
    def checked(batch: DataFrame, n: int) -> None:
        if stop.asked():
            raise Stopped
        handle(batch, n)

    query = queue.processed(stream, checked, checkpoint)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stop.asked():
            raise
        return False
    return True
