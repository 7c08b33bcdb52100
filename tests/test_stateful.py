"""Streams with state: retries, restarts, pieces of any cut, resumed work, and a stop between batches."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sheafmill.sources import shared
from sheafmill.streaming import queue, stateful


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def paths(spark, *names):
    return [shared.fresh_path(spark, f"test-{n}") for n in names]


JOBS = "job_id long, payload string"


def run(job_id, payload, failures):
    """Payloads say how often a job fails before it succeeds."""
    if failures < int(payload):
        raise ValueError(f"{job_id} fails with {failures} failures")


def expected(jobs, most, base):
    rows = []
    for job_id, payload in jobs.items():
        for n in range(1, most + 1):
            if n > int(payload):
                rows.append((job_id, n, "done", None, None))
                break
            rows.append((job_id, n, "failed" if n == most else "queued", None if n == most else base * 2**n, f"{job_id} fails with {n - 1} failures"))
    return sorted(rows, key=str)


def test_retries(spark):
    """Jobs wait twice as long after each failure, and are given up after the third; a restart from the checkpoint knows whom to wait for, and a job
    that comes again is not run again."""
    source, out, marks = paths(spark, "jobs", "tried", "marks")
    jobs = {1: "0", 2: "2", 3: "9", 4: "1"}
    spark.createDataFrame([(k, v) for k, v in jobs.items() if k < 4], JOBS).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: stateful.retried(spark.readStream.schema(JOBS).parquet(source), run, 3, 0.25)
    rows = lambda: [tuple(r) for r in spark.read.schema(stateful.TRIED).parquet(out).collect()] if shared.exists(spark, f"{out}/_spark_metadata") else []
    stateful.collected(stream(), out, marks, lambda: len(rows()) >= 3)  # stopped while jobs wait
    spark.createDataFrame([(4, jobs[4]), (1, "9")], JOBS).coalesce(1).write.mode("append").parquet(source)
    stateful.collected(stream(), out, marks, lambda: sum(r[2] != "queued" for r in rows()) >= 4)
    assert sorted(rows(), key=str) == expected(jobs, 3, 0.25)


def test_waits_are_kept():
    """The first failure of five waits 10 s, the fourth 80 s, and there is no fifth wait."""
    assert [w for *_, w, _ in expected({7: "9"}, queue.MAX_ATTEMPTS, queue.BASE_SECONDS)] == [10, 20, 40, 80, None]


def cut(body, pick):
    places = sorted(pick.sample(range(len(body) + 1), min(len(body), pick.randint(0, 12))))
    return [body[a:b] for a, b in zip([0, *places], [*places, len(body)], strict=True)]


CHUNKS = "stream_id string, seq long, chunk binary"


@pytest.mark.parametrize("mark", ["\n", "\n\n"])
def test_pieces_of_any_cut(spark, mark):
    """Cut within characters and marks, out of order over batches, with chunks that come twice: each line is read once. A tail without its mark waits."""
    pick = random.Random(len(mark))
    bodies, rows = {}, []
    for k in range(6):
        lines = ["".join(pick.choices("abé日𝄞{}: ", k=pick.randint(0 if mark == "\n" else 1, 9))).strip(":") for _ in range(pick.randint(1, 9))]
        bodies[f"s{k}"] = [x or "y" for x in lines]
        rows += [(f"s{k}", seq, chunk) for seq, chunk in enumerate(cut((mark.join(bodies[f"s{k}"]) + (mark if k % 2 else "")).encode(), pick))]
    rows += pick.sample(rows, 10)
    pick.shuffle(rows)
    source, out, marks = paths(spark, "chunks", "lines", "marks")
    for k in range(3):
        spark.createDataFrame([(s, n, bytearray(c)) for s, n, c in rows[k::3]], CHUNKS).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.pieced(spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(source), mark)
        stateful.collected(stream, out, marks)  # a restart after each part
    got = sorted((r.stream_id, r.n, r.line) for r in spark.read.schema(stateful.LINES).parquet(out).collect())
    want = sorted((s, n, line) for s, lines in bodies.items() for n, line in enumerate(lines if int(s[1:]) % 2 else lines[:-1]))
    assert got == want


class Calls:
    """Value and map states that count their calls."""

    def __init__(self):
        self.calls, self.value, self.held = 0, None, {}

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls, self.held[key] = self.calls + 1, value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


def test_early_chunks_cost_a_call_a_block():
    """600 chunks that wait, then the first, then the rest: two calls and at most two a block each time, and no block stays."""
    states, size = Calls(), stateful.EARLY_BLOCK
    piece = stateful.Pieced(b"\n")
    piece.init(states)
    lines = []
    for seqs in (range(1, 601), range(3 * size, 3 * size + 9), [0, 5, 5], range(601, 3 * size)):
        before, blocks = states.calls, len({s // size for s in seqs})
        lines += piece.handleInputRows(("a",), iter([Row(stream_id="a", seq=s, chunk=b"%d\n" % s) for s in seqs]), None)
        assert states.calls - before <= 2 + 2 * (blocks + 3)
    assert [(r.n, r.line) for r in lines] == [(i, str(i)) for i in range(3 * size + 9)]
    assert not states.held and states.value == (3 * size + 9, 3 * size + 9, b"", 0)


def test_frames_over_cuts(spark):
    events = [{"type": "created"}, {"type": "token", "text": "é 日"}, {"type": "done"}]
    body = "".join(f"event: x\ndata: {json.dumps(e, ensure_ascii=False)}\n\n" for e in events).encode()
    chunks = spark.createDataFrame([("a", i, bytearray(body[i : i + 1])) for i in range(len(body))], CHUNKS)
    frames = stateful.frames_of(stateful.pieced(chunks, "\n\n"))
    assert [(r.n, r.event) for r in frames.orderBy("n").collect()] == list(enumerate(events))


ROWS = [(i, f"text {i}" if i % 7 else None) for i in range(-3, 40)] + [(5, "text 5"), (None, "nobody")]


def test_resumed_after_a_kill(spark):
    """A run that dies after its second batch goes on behind it, and does nothing twice."""
    rows, (path,) = spark.createDataFrame(ROWS, "id long, content string"), paths(spark, "values")
    heard = []

    def killed(done, left):
        heard.append((done, left))
        if len(heard) == 2:
            raise KeyboardInterrupt

    size = lambda texts: [len(t) for t in texts]
    with pytest.raises(KeyboardInterrupt):
        stateful.resumed(rows, size, path, "long", 10, on_batch=killed)
    first = {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()}
    made = stateful.resumed(rows, size, path, "long", 10, on_batch=lambda *x: heard.append(x))
    assert sorted(map(tuple, made.collect())) == sorted((i, len(t or "")) for i, t in set(ROWS) if i is not None)
    assert heard == [(10, 33), (20, 23), (30, 13), (40, 3), (43, 0)]
    files = {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()}
    assert first <= files
    assert stateful.resumed(rows, size, path, "long", 10, on_batch=lambda *x: heard.append(x)).count() == 43 and len(heard) == 5  # nothing is left
    later = rows.union(spark.createDataFrame([(99, "late one")], "id long, content string"))
    assert stateful.resumed(later, size, path, "long", 10).count() == 44
    assert stateful.resumed(rows.where("false"), size, paths(spark, "none")[0], "long").count() == 0


def test_resumed_reads_its_rows_a_few_times(spark):
    """However many batches there are: rows are dealt to them in one pass."""
    seen, (path,) = spark.sparkContext.accumulator(0), paths(spark, "values")

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(120).selectExpr("id", "cast(id AS string) AS content").mapInPandas(counted, "id long, content string")
    made = stateful.resumed(rows, lambda texts: [len(t) for t in texts], path, "long", 5)
    assert sorted(map(tuple, made.collect())) == [(i, len(str(i))) for i in range(120)] and seen.value <= 5 * 120
    assert sorted(r.batch for r in spark.read.parquet(path).select("batch").distinct().collect()) == list(range(0, 120, 5))


def test_stop_between_batches(spark):
    """A stream that is asked to stop ends before its next batch; a later run handles the rest, each row once."""
    source, marks, out, flag = paths(spark, "source", "marks", "out", "stop")
    for k in range(4):
        spark.createDataFrame([(k, str(k))], JOBS).coalesce(1).write.mode("append").parquet(source)
    stop, seen = stateful.Stop(spark, flag), []

    def handle(batch, n):
        queue.once_by_batch(batch, n, out)
        seen.append(n)
        if n == 1:
            stop.ask()

    stream = lambda: queue.event_stream(spark, source, JOBS, 1)
    assert not stateful.until_stopped(stream(), handle, marks, stop) and seen == [0, 1]
    assert not stateful.until_stopped(stream(), handle, marks, stop) and seen == [0, 1]  # still asked to
    stop.clear()
    assert stateful.until_stopped(stream(), handle, marks, stop) and seen == [0, 1, 2, 3]
    assert sorted(r.job_id for r in spark.read.schema(JOBS).parquet(out).collect()) == [0, 1, 2, 3]


def test_other_failures_are_raised(spark):
    source, marks, flag = paths(spark, "source", "marks", "stop")
    spark.range(1).select(F.col("id").alias("job_id"), F.lit("x").alias("payload")).coalesce(1).write.parquet(source)

    def broken(batch, n):
        raise RuntimeError("broken")

    with pytest.raises(Exception, match="broken"):
        stateful.until_stopped(queue.event_stream(spark, source, JOBS), broken, marks, stateful.Stop(spark, flag))
