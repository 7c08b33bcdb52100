"""The job queue and event log as streams: micro-batches, retries with backoff, progress, windows, and ordered reply streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafmill.functions import measures

MAX_ATTEMPTS, BASE_SECONDS = 5, 5


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def processed(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what is there through `handle` in micro-batches and stops; a batch may come again after a failure, so handlers are idempotent by id."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_by_batch(batch: DataFrame, n: int, path: str) -> None:
    """Writes micro-batch n into a folder of its own: a batch that comes again replaces itself, whatever the table's size."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def once_by_id(batch: DataFrame, path: str, key: str) -> None:
    """Appends rows of a batch whose ids the table doesn't have yet; for sources that may repeat a row in another batch. Reads the ids alone."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    try:
        known = spark.read.parquet(path).select(key)
    except AnalysisException as missing:  # the first batch finds no table
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    (fresh if known is None else fresh.join(known, key, "left_anti")).write.mode("append").parquet(path)


def job_states(attempts: DataFrame, job: str = "job_id", at: str = "ts", order: str = "event_id", failed: str = "failed", most: int = MAX_ATTEMPTS) -> DataFrame:
    """State of each job by its attempts in order: done at its first success, dead after `most` failures in a row before one, else pending with its next run.
    The fold of the attempts so far is a window and an aggregate; hot jobs keep one row an attempt only of narrow columns."""
    turn = F.row_number().over(Window.partitionBy(job).orderBy(at, order))
    rows = attempts.select(job, F.col(at).alias("at"), F.col(failed).alias("failed"), turn.alias("turn"))
    per = rows.groupBy(job).agg(F.min(F.when(~F.col("failed"), F.col("turn"))).alias("ok"), F.max("turn").alias("n"), F.max("at").alias("last"))
    failures = F.least(F.coalesce(F.col("ok") - 1, F.col("n")), F.lit(most)).cast("long")
    status = F.when(failures >= most, "dead").when(F.col("ok").isNotNull(), "done").otherwise("pending")
    per = per.select(job, failures.alias("failures"), status.alias("status"), "last")
    wait = measures.backoff_seconds(F.col("failures"), BASE_SECONDS)
    return per.select(job, "failures", "status", F.when(F.col("status") == "pending", wait).alias("wait_seconds"))


def runnable(jobs: DataFrame, now: F.Column, n: int = 1) -> DataFrame:
    """The oldest jobs that may run: pending or running, due, attempts left."""
    return jobs.where(F.col("status").isin("pending", "running") & (F.col("run_after") <= now) & (F.col("attempts") < F.col("max_attempts"))).orderBy("run_after", "job_id").limit(n)


def claimed(jobs: DataFrame, now: F.Column, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The jobs after a worker has taken the n oldest that may run, and those n. They are `running` and locked from now on; the rest is as it was."""
    taken = runnable(jobs, now, n).select(F.col("job_id").alias("_id"))
    marked = jobs.join(F.broadcast(taken), F.col("job_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    changed = {"status": F.when(hit, "running").otherwise(F.col("status")), "locked_at": F.when(hit, now).otherwise(F.col("locked_at"))}
    after = marked.withColumns(changed)
    return after.drop("_id"), after.where(hit).drop("_id")


def mapped_in_batches(rows: DataFrame, of: Callable[[list], list], column: str, name: str, kind: str, size: int = 32) -> DataFrame:
    """`rows` with a column that `of` makes of lists of up to `size` values at a time, value for value; a task works on one list at once."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), size):
                part = batch.iloc[k : k + size]
                yield part.assign(**{name: of(list(part[column]))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(apply, f"{fields}, {name} {kind}")


def progress(events: DataFrame, job: str = "user_id") -> DataFrame:
    """Counts by job and kind; as a stream, in update mode."""
    return events.groupBy(job).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last"))


def frames_until_end(states: DataFrame, job: str, order: list[str], status: str = "status", most: int = 600) -> DataFrame:
    """The states (job, order ..., status) that a watcher of each job is sent: in order, up to the first that is done or failed, `most` at most."""
    upto = Window.partitionBy(job).orderBy(*order)
    ended = F.coalesce(F.sum(F.col(status).isin("done", "failed").cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return states.withColumn("frame", F.row_number().over(upto).cast("long")).withColumn("_ended", ended).where((F.col("_ended") == 0) & (F.col("frame") <= most)).drop("_ended")


def windowed(events: DataFrame, width: str = "1 day", late: str | None = "2 hours") -> DataFrame:
    """Events and their value by kind and tumbling window of event time. A stream drops rows later than `late`; with None it drops none,
    and keeps a row of state a window and kind."""
    marked = events.withWatermark("ts", late) if events.isStreaming and late else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100, 2).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def frames(text: DataFrame) -> DataFrame:
    """(stream_id, n, event) of server-sent frames: parted by blank lines, the first data line of each."""
    parted = text.select("stream_id", F.posexplode(F.split("body", "\n\n")).alias("n", "frame"))
    data = F.regexp_extract("frame", "(?m)^data: ?(.*)$", 1)
    return parted.where(data != "").select("stream_id", F.col("n").cast("long").alias("n"), F.from_json(data, "map<string,string>").alias("event"))


def reply_states(events: DataFrame, stream: str, order: list[str], mark: str = "\n") -> DataFrame:
    """(stream, state, citations, text, n) of each reply's events (stream, order ..., kind, data): its tokens in order up to the first `done` or
    `error`, which is its state (`open` without one), and the first citations before that."""
    ends = F.when(F.col("kind") == "done", "done").when(F.col("kind") == "error", "failed").otherwise("running")
    sent = frames_until_end(events.withColumn("_status", ends), stream, order, "_status", (1 << 31) - 1)
    tokens = F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("frame", "data"))))
    state = F.when(F.count_if(F.col("kind") == "error") > 0, "error").when(F.count_if(F.col("kind") == "done") > 0, "done").otherwise("open")
    cited = F.min_by("data", F.when(F.col("kind") == "citations", F.col("frame")))
    return sent.groupBy(stream).agg(state.alias("state"), cited.alias("citations"), F.array_join(F.transform(tokens, lambda x: x["data"]), mark).alias("text"), F.count_if(F.col("kind") == "token").alias("n"))


def replies(tokens: DataFrame) -> DataFrame:
    """(conv_id, text, n) of ordered tokens (conv_id, seq, token)."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "token")))
    return tokens.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), " ").alias("text"), F.count("*").alias("n"))
