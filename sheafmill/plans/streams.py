"""Stream queries: micro-batch runs over what is there, and the batch equivalents of the queue's folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafmill.operators import latency, retrieval
from sheafmill.plans import adapters as A
from sheafmill.sources import files, shared
from sheafmill.streaming import queue, stateful

T = A.table
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def job_state_fold(spark, sf_dir):
    """Users as jobs, error events as failed attempts."""
    e = T(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return queue.job_states(e)


def job_progress(spark, sf_dir):
    """Progress by job through a stream, into a table by micro-batches of events."""
    path, marks = shared.fresh_path(spark, "progress"), shared.fresh_path(spark, "progress-marks")
    stream = queue.event_stream(spark, f"{sf_dir}/events.parquet*", EVENTS)
    queue.processed(stream, lambda batch, n: queue.once_by_batch(batch, n, path), marks).awaitTermination()
    return queue.progress(spark.read.schema(EVENTS).parquet(path)).select("user_id", "events", "errors")


def event_time_windows(spark, sf_dir, files_per_batch=64):
    """Daily counts and values by kind, run as a stream. Files come in any order of time, so no watermark closes a day."""
    path, marks = shared.fresh_path(spark, "windows"), shared.fresh_path(spark, "windows-marks")
    stream = queue.event_stream(spark, f"{sf_dir}/events.parquet*", EVENTS, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp"))
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/{n}")
    query = queue.windowed(stream, late=None).writeStream.outputMode("update").foreachBatch(lambda b, n: keep(b.withColumn("batch", F.lit(n)), n)).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    last = rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("value", "batch").alias("value"))
    return last.select(F.col("start").cast("date").alias("day"), "event_type", "n", "value")


def reply_streams(spark, sf_dir):
    """Replies of model streams put together: a stream is JSON lines of a token each, which arrive out of order; lines that hold none, and the last
    line that says the stream is done, add nothing."""
    m = T(spark, sf_dir, "conversations").where("role = 'assistant'")
    tokens = m.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "token"))
    lines = tokens.select("conv_id", "turn", "i", F.to_json(F.struct(F.col("token").alias("response"), F.lit(False).alias("done"))).alias("value"))
    ends = m.select("conv_id", "turn", F.explode(F.array(F.lit(-1), F.lit(1 << 30))).alias("i")).withColumn("value", F.when(F.col("i") < 0, "not json").otherwise('{"response":"","done":true}'))
    sent = lines.unionByName(ends).repartition("value")
    read = files.token_lines(sent, "conv_id", "turn", "i").where("NOT done")
    return queue.replies(read.select("conv_id", F.struct("turn", "i").alias("seq"), F.col("response").alias("token"))).select("conv_id", F.sha2("text", 256).alias("sha256"), "n")


def job_claim(spark, sf_dir):
    """Events as jobs: the 25 oldest that may run are taken."""
    e = T(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "pending").when(F.col("event_type") == "signup", "running").otherwise("done")
    jobs = e.select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("run_after"), (F.col("user_id") % 7).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), F.lit(None).cast("timestamp_ntz").alias("locked_at"))
    after, _ = queue.claimed(jobs, F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")), 25)
    return after.groupBy("status", F.col("locked_at").isNotNull().alias("locked")).agg(F.count("*").alias("n"), F.min("job_id").alias("first_id"), F.sum("job_id").alias("ids"))


def progress_frames(spark, sf_dir):
    """A user's events as states of a job that a purchase ends: how many frames a watcher is sent, and the last."""
    e = T(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"))
    return queue.frames_until_end(e, "user_id", ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("frames"), F.max_by("event_id", "frame").alias("last_id"), F.max_by("status", "frame").alias("status"))


#: Kinds of a reply's events by those of the table.
REPLY_KINDS = {"signup": "created", "click": "citations", "view": "token", "error": "error", "purchase": "done"}


def chat_streams(spark, sf_dir):
    """A user's events of a day as those of a reply."""
    e = T(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in REPLY_KINDS.items()])
    events = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("stream"), "ts", "event_id", kind.alias("kind"), F.col("event_id").cast("string").alias("data"))
    return queue.reply_states(events, "stream", ["ts", "event_id"], " ")


def batched_map(spark, sf_dir):
    """Token counts of texts made 32 texts at a time, as an embedder is called."""
    rows = T(spark, sf_dir, "documents").select("doc_id", "text")
    made = queue.mapped_in_batches(rows, lambda texts: [len(t.encode()) for t in texts], "text", "n_bytes", "long")
    return made.select("doc_id", "n_bytes")


def as_stream(spark, rows, label, files=4, files_per_batch=1):
    """Rows as a stream of several files."""
    path = shared.fresh_path(spark, label)
    rows.repartition(files).write.parquet(path)
    return queue.event_stream(spark, path, rows.schema, files_per_batch)


def job_retries(spark, sf_dir):
    """Users as jobs that fail as often as their error events say, by sevens; every attempt of a stream of them, with its wait."""
    stateful.state_store(spark)
    e = T(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg((F.count_if(F.col("event_type") == "error") % 7).cast("string").alias("payload"))
    jobs = shared.written(e, "retry-jobs")
    n, out, marks = jobs.count(), shared.fresh_path(spark, "retries"), shared.fresh_path(spark, "retries-marks")

    def run(job_id, payload, failures):
        if failures < int(payload):
            raise ValueError(f"failure {failures + 1} of {payload}")

    tried = lambda: spark.read.schema(stateful.TRIED).parquet(out)
    ended = lambda: shared.exists(spark, f"{out}/_spark_metadata") and tried().where("status <> 'queued'").count() == n
    stateful.collected(stateful.retried(as_stream(spark, jobs, "retry-source"), run, base=1 / 64), out, marks, ended, most_seconds=600)
    return tried()


def reply_pieces(spark, sf_dir):
    """Replies of model streams, whose JSON lines come as chunks of 97 bytes in any order, put together."""
    stateful.state_store(spark)
    m = T(spark, sf_dir, "conversations").where("role = 'assistant'")
    line = lambda t: F.concat(F.to_json(F.struct(t.alias("response"), F.lit(False).alias("done"))), F.lit("\n"))
    body = F.concat(F.array_join(F.transform(F.split("text", " "), line), ""), F.lit('{"response":"","done":true}\n')).cast("binary")
    rows = m.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"), body.alias("body"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("body") - 1) / 97).cast("int")), lambda i: F.substring("body", i * 97 + 1, F.lit(97)))
    chunks = rows.select("stream_id", F.posexplode(cut).alias("seq", "chunk")).select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk")
    out, marks = shared.fresh_path(spark, "pieces"), shared.fresh_path(spark, "pieces-marks")
    stateful.collected(stateful.pieced(as_stream(spark, chunks, "piece-source")), out, marks)
    lines = spark.read.schema(stateful.LINES).parquet(out).withColumnRenamed("line", "value")
    read = files.token_lines(lines, "stream_id", "n").where("NOT done")
    said = read.select(F.split_part("stream_id", F.lit("/"), F.lit(1)).cast("long").alias("conv_id"), F.struct(F.split_part("stream_id", F.lit("/"), F.lit(2)).cast("long").alias("turn"), "n").alias("seq"), F.col("response").alias("token"))
    return queue.replies(said).select("conv_id", F.sha2("text", 256).alias("sha256"), "n")


def progress_resumed(spark, sf_dir):
    """`job_progress` by a stream that is stopped after its first batch, and run again."""
    path, marks = shared.fresh_path(spark, "progress"), shared.fresh_path(spark, "progress-marks")
    stop, rows = stateful.Stop(spark, shared.fresh_path(spark, "progress-stop")), T(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    source = shared.fresh_path(spark, "progress-source")
    rows.repartition(4).write.parquet(source)

    def handle(batch, n):
        queue.once_by_batch(batch, n, path)
        if n == 0:
            stop.ask()

    stream = lambda: queue.event_stream(spark, source, rows.schema, 1)
    stateful.until_stopped(stream(), handle, marks, stop)
    stop.clear()
    stateful.until_stopped(stream(), handle, marks, stop)
    return queue.progress(spark.read.schema(rows.schema).parquet(path)).select("user_id", "events", "errors")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def pending_vectors(spark, sf_dir):
    """Vectors of the chunks that have none yet, made by batches that can be resumed: counts of letters stand in for an embedder's numbers."""
    pending = A.chunks(spark, sf_dir).where("embedding IS NULL").select("id", "content")
    letters = LETTERS

    def of(texts):
        return [[t.count(c) + t.count(c.upper()) for c in letters] for t in texts]

    made = stateful.resumed(pending, of, shared.fresh_path(spark, "pending"), "array<long>", 2048)
    return made.select("id", F.array_join(F.transform("value", lambda x: x.cast("string")), ",").alias("vector"))


def search_latencies(spark, sf_dir):
    """Measured latencies of up to 60 exact searches of 32 rows each, and whether all were planned as a sort with a limit."""
    rows = T(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = [list(r[0]) for r in rows.where("id % 20 = 0").orderBy("id").limit(60).select("embedding").collect()]
    return latency.reported(latency.measured(spark, "dense_one", [lambda q=q: retrieval.dense_one(rows, q, 32) for q in asked], "TakeOrderedAndProject"))


QUERIES = {f.__name__: f for f in (job_retries, reply_pieces, progress_resumed, pending_vectors, search_latencies, job_state_fold, job_progress, event_time_windows, reply_streams, job_claim, progress_frames, chat_streams, batched_map)}

REPLIES_SQL = "SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS sha256, sum(len(string_split(text, ' ')))::BIGINT AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id"

ORACLE = {
    "job_retries": """WITH j AS (SELECT user_id AS job_id, count(*) FILTER (event_type = 'error') % 7 AS p FROM events GROUP BY user_id), a AS (SELECT job_id, p, unnest(range(1, least(p + 1, 5) + 1)) AS k FROM j)
SELECT job_id, k::INT AS attempt, CASE WHEN k > p THEN 'done' WHEN k = 5 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN k <= p AND k < 5 THEN pow(2, k) / 64 END AS wait_seconds,
  CASE WHEN k <= p THEN 'failure ' || k || ' of ' || p END AS error FROM a""",
    "reply_pieces": REPLIES_SQL,
    "progress_resumed": "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id",
    "pending_vectors": f"""WITH {A.CHUNKS_SQL} SELECT id, array_to_string(list_transform(string_split('{LETTERS}', ''), lambda c: 2 * length(content) - length(replace(content, c, '')) - length(replace(content, upper(c), ''))), ',') AS vector
FROM chunks WHERE embedding IS NULL""",
    "job_state_fold": """WITH t AS (SELECT user_id AS job_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
p AS (SELECT job_id, min(turn) FILTER (NOT failed) AS ok, max(turn) AS n FROM t GROUP BY job_id), f AS (SELECT job_id, ok, least(coalesce(ok - 1, n), 5)::BIGINT AS failures FROM p),
s AS (SELECT job_id, failures, CASE WHEN failures >= 5 THEN 'dead' WHEN ok IS NOT NULL THEN 'done' ELSE 'pending' END AS status FROM f)
SELECT *, CASE WHEN status = 'pending' THEN (5 * pow(2, failures))::BIGINT END AS wait_seconds FROM s""",
    "job_progress": "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id",
    "event_time_windows": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(round(value * 100)::BIGINT) / 100, 2) AS value FROM events GROUP BY ALL",
    "job_claim": """WITH j AS (SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'pending' WHEN 'signup' THEN 'running' ELSE 'done' END AS status, ts AS run_after, user_id % 7 AS attempts FROM events),
t AS (SELECT job_id FROM j WHERE status IN ('pending', 'running') AND run_after <= TIMESTAMP '2024-01-20 00:00:00' AND attempts < 5 ORDER BY run_after, job_id LIMIT 25),
a AS (SELECT j.job_id, CASE WHEN t.job_id IS NOT NULL THEN 'running' ELSE status END AS status, t.job_id IS NOT NULL AS locked FROM j LEFT JOIN t USING (job_id))
SELECT status, locked, count(*) AS n, min(job_id) AS first_id, sum(job_id)::BIGINT AS ids FROM a GROUP BY status, locked""",
    "progress_frames": """WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS ends, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events),
f AS (SELECT e.*, min(frame) FILTER (ends) OVER (PARTITION BY user_id) AS stop FROM e) SELECT user_id, count(*) AS frames, max_by(event_id, frame) AS last_id, CASE WHEN bool_or(ends) THEN 'done' ELSE 'running' END AS status
FROM f WHERE frame <= least(coalesce(stop, 600), 600) GROUP BY user_id""",
    "chat_streams": """WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS stream, event_id, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT *, min(k) FILTER (event_type IN ('error', 'purchase')) OVER (PARTITION BY stream) AS stop FROM e), s AS (SELECT * FROM f WHERE k <= coalesce(stop, k))
SELECT stream, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'open' END AS state, (arg_min(event_id, k) FILTER (event_type = 'click'))::VARCHAR AS citations,
  coalesce(string_agg(event_id::VARCHAR, ' ' ORDER BY k) FILTER (event_type = 'view'), '') AS text, count(*) FILTER (event_type = 'view') AS n FROM s GROUP BY stream""",
    "batched_map": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes FROM documents",
    "reply_streams": REPLIES_SQL,
}
