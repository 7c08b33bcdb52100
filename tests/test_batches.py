"""What Python workers hold at a time: small parts of a batch, whatever its size."""

import itertools
import re
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheafmill.functions import batches, texts
from sheafmill.functions import segmentation as seg
from sheafmill.operators import chunking, retrieval


def held(make):
    """Peak MB of Python objects while `make` runs, and its result."""
    tracemalloc.start()
    out = make()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 2**20, out


def test_segmented_batches_hold_a_part():
    """Some 40 MB of different runs are a few MB of Python objects at a time; results are those of the runs one by one."""
    by = seg.Segmenter(["ໂຄງການ", "ບັນຊີ"])
    digits = str.maketrans("0123456789", "ກຂຄງຈສຊຍດຕ")
    run = lambda k: "ໂຄງການບັນຊີ" + f"{k:06d}".translate(digits)
    rows = pa.array([None, [], *([run(k * 100 + i) for i in range(100)] for k in range(2000))], pa.list_(pa.string()))
    peak, found = held(lambda: batches.by_parts(rows, lambda part: seg.parted_lists(part, seg.Memory(by, 2000))))
    assert len(found) == len(rows) and found[0].as_py() is None and found[1].as_py() == []
    assert found[1234].as_py() == [t for piece in rows[1234].as_py() for t in by.tokens(piece)]
    assert peak < 30


def test_counts_of_sliced_lists():
    memory = seg.Memory(seg.Segmenter(["ໂຄງການ", "ບັນຊີ"]))
    rows = pa.array([[["x"]], [["ໂຄງການບັນຊີ", "a"], [], None], None, [], [["b"], ["ໂຄງການ"]]], pa.list_(pa.list_(pa.string())))
    assert seg.counted_lists(rows.slice(1), memory).to_pylist() == [[3, 0, 0], None, [], [1, 1]]
    assert seg.counted_lists(rows.slice(2, 2), memory).to_pylist() == [None, []]
    assert batches.by_parts(rows, lambda part: seg.counted_lists(part, memory), 8).to_pylist() == seg.counted_lists(rows, memory).to_pylist()


def test_composed_texts_stay_out_of_python(spark):
    """Only texts with a character from U+0300 on are given to Python; results are the same for all."""
    plan = spark.range(3).select(texts.nfc(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE" in plan
    rows = [("\u00e9 plain \u00df",), ("e\u0301",), ("\u1100\u1161",), ("\u212b",), ("\u00e9",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(texts.nfc(F.col("t"))).collect()]
    assert got == ["\u00e9 plain \u00df", "\u00e9", "\uac00", "\u00c5", "\u00e9", "", None]


def test_normal_texts_of_the_script_stay_out_of_python(spark):
    """Marks of the script may be out of order, but a text is given to Python only if they are: all runs of three of its marks, and its other characters."""
    marks = [c for c in map(chr, range(0xE80, 0xF00)) if unicodedata.combining(c)]
    said = ["ກ" + "".join(m) for m in itertools.product([*marks, "ຣ"], repeat=3)] + [a + b for a in map(chr, range(0xE80, 0xF00)) for b in ("e", "\u0301")]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", texts.nfc(F.col("t")).alias("n"), F.col("t").rlike(texts.MISPLACED_MARK).alias("m")).collect()
    assert all(r.n == unicodedata.normalize("NFC", r.t) for r in rows)
    assert all(r.m == (not unicodedata.is_normalized("NFC", r.t)) for r in rows if "\u0301" not in r.t)


def test_blanks_are_squeezed_alike(spark):
    blanks = " \t\n\x0b\u0085\u00a0\u2003\u2028\u200b"
    said = ["".join(x) for n in (1, 2, 3) for x in itertools.product([*blanks, "a"], repeat=n)]
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", texts.squeezed(F.col("t")).alias("n")).collect()
    assert all(r.n == re.sub("^ | $", "", re.sub("[ \t\n\x0b\u0085\u00a0\u2003\u2028]+", " ", r.t.replace("\u200b", ""))) for r in got)


def test_chunks_keep_ids_beside_null(spark):
    """Ids don't pass through doubles beside a missing one."""
    rows = spark.createDataFrame([(2**53 + 1, "a b. c."), (None, "d.")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in chunking.sentence_chunks(rows).collect()} == {2**53 + 1, None}
    blocks = spark.createDataFrame([(2**53 + 1, [("prose", "a b", [])]), (None, [("prose", "c", ["h"])])], "doc_id long, blocks array<struct<kind:string,text:string,path:array<string>>>").coalesce(1)
    assert {(r.doc_id, tuple(r.path)) for r in chunking.block_chunks(blocks).collect()} == {(2**53 + 1, ()), (None, ("h",))}


class Watched:
    """Lists that refuse to rank too many rows at a time."""

    centroids = np.eye(200)
    most = retrieval.DEALT

    def ranked(self, unit):
        assert len(unit) * len(self.centroids) <= self.most
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")


def test_rows_are_dealt_in_parts(spark):
    rows = spark.range(1000).coalesce(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: (k == F.col("id") % 200).cast("float")).alias("embedding"))
    got = retrieval.dealt_to_lists(rows, "id", Watched(), 3)
    assert got.count() == 3000 and got.where("list = id % 200").count() == 1000
