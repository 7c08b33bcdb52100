"""Word segmentation against all paths of small lattices, many terms at once, and texts of any length."""

import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafmill.functions import batches, texts
from sheafmill.functions import segmentation as seg
from sheafmill.operators import assist, chunking, curation

LETTERS = ["ກ", "ຂາ", "ໂຄ", "ງ", "ນີ້", "໑", "ໆ"]


def all_paths(clusters, words):
    """The best of all ways to cut: fewest characters outside of words, fewest tokens, then a word first and the longer one, and the shorter stretch outside."""
    best = None
    for cuts in itertools.product((False, True), repeat=max(0, len(clusters) - 1)):
        parts, part = [], [clusters[0]]
        for cluster, cut in zip(clusters[1:], cuts, strict=True):
            if cut:
                parts.append(part)
                part = []
            part.append(cluster)
        parts.append(part)
        known = ["".join(p) in words or len(p) == 1 and bool(seg._BY_ITSELF.fullmatch(p[0])) for p in parts]
        if any(not a and not b for a, b in itertools.pairwise(known)):
            continue  # outside of words side by side is one token
        said = ["".join(p) for p in parts]
        key = (sum(len(s) for s, k in zip(said, known, strict=True) if not k), len(parts), [(not k, -len(p) if k else len(p)) for p, k in zip(parts, known, strict=True)])
        if best is None or key < best[0]:
            best = (key, said)
    return best[1]


@pytest.mark.parametrize("seed", range(6))
def test_segmentation_by_brute_force(seed):
    pick = random.Random(seed)
    words = {"".join(pick.choices(LETTERS, k=pick.randint(1, 4))) for _ in range(12)}
    by = seg.Segmenter(list(words))
    for _ in range(150):
        run = "".join(pick.choices(LETTERS, k=pick.randint(1, 9)))
        clusters = seg._CLUSTER.findall(run)
        assert "".join(clusters) == run
        assert by.tokens(run) == all_paths(clusters, words)


def test_segmentation_rules():
    by = seg.Segmenter(["ໂຄງການ", "ບັນຊີ", "ການ", "ກາ", "ນບັນ"])
    assert by.tokens("ໂຄງການບັນຊີ") == ["ໂຄງການ", "ບັນຊີ"]
    assert by.tokens("ຂຂໂຄງການ໑໒໓ຂ") == ["ຂຂ", "ໂຄງການ", "໑໒໓", "ຂ"]
    assert by.tokens("ກັ") == ["ກັ"] and by.tokens("") == [] and seg.Segmenter([]).tokens("ໂຄງການ") == ["ໂຄງການ"]
    assert by.tokens("ໂຄງການ" * 100_000) == ["ໂຄງການ"] * 100_000


def test_segmented_texts(spark):
    by = seg.segmenter(spark.createDataFrame([("ໂຄງການ",), ("ບັນຊີ",), ("latin",), (None,), ("",), ("ບັນຊີ",)], "word string"))
    rows = [(1, "ໂຄງການບັນຊີ 2024 abcບັນຊີ!"), (2, None), (3, ""), (4, "  \n"), (5, "plain words, only"), (6, "ບັນຊີບັນຊີ\nx")]
    got = {r.id: (r.x.tokens, r.x.joined, r.x["count"], r.x.lang) for r in spark.createDataFrame(rows, "id long, text string").select("id", seg.segmented(F.col("text"), by).alias("x")).collect()}
    assert got[1][:3] == (["ໂຄງການ", "ບັນຊີ", "2024", "abc", "ບັນຊີ", "!"], "ໂຄງການ ບັນຊີ 2024 abc ບັນຊີ !", 6)
    assert got[2] == got[3] == got[4] == ([], "", 0, "en") and got[5][0] == ["plain", "words,", "only"] and got[6][0] == ["ບັນຊີ", "ບັນຊີ", "x"]


@pytest.mark.parametrize("seed", range(4))
def test_runs_cut_together(seed):
    """Many runs at once are cut as one by one, at all places of an array, beside other pieces and runs too long for it."""
    pick, letters = random.Random(seed), [*LETTERS, "ເ", "ະ", "ຯ", "໊", "\u0e80", "\u0eff", "໒"]
    for _ in range(25):
        by = seg.Segmenter(["".join(pick.choices(letters, k=pick.randint(1, 4))) for _ in range(pick.randint(0, 20))])
        found = ["".join(pick.choices(letters, k=pick.randint(1, 14))) for _ in range(50)] + ["abc", "ก", "é—", "".join(pick.choices(letters, k=400))]
        pick.shuffle(found)
        want = [by.tokens(p) if "\u0e80" <= p[0] <= "\u0eff" else [p] for p in found]
        assert seg.cut(pa.array(found).slice(3), seg.Memory(by)).to_pylist() == want[3:]
    assert seg.cut(pa.array([], pa.string()), seg.Memory(by)).to_pylist() == []


def test_words_of_texts_by_brute_force():
    """Different words and unknown ones, over texts that are null, empty, without the script, next to each other and cut into parts."""
    pick, letters = random.Random(9), [*LETTERS, " ", ",", "é", "ก", "\n"]
    for _ in range(40):
        words = ["".join(pick.choices(LETTERS, k=pick.randint(1, 4))) for _ in range(12)]
        by, known = seg.Segmenter(words), set(words[::2])
        texts_ = [None if pick.random() < 0.1 else "".join(pick.choices(letters, k=pick.choice([0, 1, 5, 40, 700]))) for _ in range(20)]
        said = [{w for run in re.findall(f"[{texts.LAO}]+", t or "") for w in by.tokens(run)} for t in texts_]
        made = lambda part: seg.checked_strings(part, seg.Memory(by), pa.array(sorted(known)))
        got = batches.by_parts(pa.array(texts_).slice(2), made, pick.choice([50, 1 << 20])).to_pylist()
        assert got == [{"words": len(s), "unknown": len(s - known)} for s in said[2:]]


def test_texts_are_checked_in_one_pass(spark):
    """By a segmenter: no shuffle, no join, the normal form made once; the same as by the words of its tokens."""
    word, other = "ໂຄງການ", "ບັນຊີ"
    known = spark.createDataFrame([(word,), ("latin",), (None,)], "word string")
    rows = spark.createDataFrame([(1, f"{word}{other}{word} x\u200b  {other} "), (2, None), (3, ""), (4, "plain  %"), (5, f"{word} {word}")], "id long, content string")
    by = seg.segmenter(known.union(spark.createDataFrame([(other,)], "word string")))
    made = assist.checked_texts(rows, known, [other, "x  ", "%"], by=by)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join|Aggregate", plan) and plan.count("regexp_replace") == 2
    want = [(1, 2, 1, [other]), (2, 0, 0, []), (3, 0, 0, []), (4, 0, 0, ["%"]), (5, 1, 0, [])]
    assert sorted(tuple(r) for r in made.collect()) == want
    assert sorted(tuple(r) for r in assist.checked_texts(rows, known, [other, "x  ", "%"], tokens=lambda t: seg.tokens(t, by)).collect()) == want


def test_a_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(seg, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        seg.segmenter(spark.createDataFrame([("ກ" * k,) for k in range(1, 5)], "word string"))


def test_plain_texts_stay_out_of_python(spark):
    """Rows without the script give Python nothing."""
    by = seg.Segmenter(["ບັນຊີ"])
    plan = spark.range(3).select(seg.tokens(F.concat(F.lit("a b "), F.col("id").cast("string")), by).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE" in plan


def test_chunks_count_segmented_words(spark):
    """A paragraph of the script is no longer one token."""
    by = seg.Segmenter(["ໂຄງການ", "ບັນຊີ"])
    docs = spark.createDataFrame([(1, ("ໂຄງການບັນຊີ" * 10 + ". ") * 8), (2, "a b. c d."), (3, "")], "doc_id long, text string")
    plain = [r.token_count for r in chunking.sentence_chunks(docs, 50, 10).orderBy("doc_id", "seq").collect()]
    counted = [r.token_count for r in chunking.sentence_chunks(docs, 50, 10, lambda found: seg.counts(found, by)).orderBy("doc_id", "seq").collect()]
    assert plain == [8, 4] and counted == [42] * 7 + [4]  # two sentences of 20 words and a full stop, of which the last is carried over
    blocks = spark.createDataFrame([(1, [("prose", "ໂຄງການບັນຊີ x", [])])], "doc_id long, blocks array<struct<kind:string,text:string,path:array<string>>>")
    assert [r.token_count for r in chunking.block_chunks(blocks, counts=lambda found: seg.counts(found, by)).collect()] == [3]
    assert [r.token_count for r in chunking.block_chunks(blocks).collect()] == [2]


# ---- many terms at once


def test_terms_by_brute_force(spark):
    pick = random.Random(4)
    terms = sorted({"".join(pick.choices("abé", k=pick.randint(1, 4))) for _ in range(60)} | {"", "ABa", "aba"})
    rows = [(i, "".join(pick.choices("aAbÉé ", k=pick.randint(0, 60)))) for i in range(80)] + [(90, None), (91, ""), (91, "aba"), (None, "aba")]
    asked, listed = spark.createDataFrame(rows, "query_id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    want = {(i, t) for i, text in rows if text is not None for t in terms if t and t.lower() in text.lower()}
    for block in (200_000, 7):  # one automaton, or several
        got = [tuple(r) for r in curation.substrings_in(asked, listed, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert curation.substrings_in(asked, listed.where("false")).count() == 0 == curation.substrings_in(asked.where("false"), listed).count()


def test_terms_in_a_very_long_text(spark):
    """Its substrings are never laid out."""
    rows = spark.range(1).select(F.col("id").alias("query_id"), F.concat(F.repeat(F.lit("lorem ipsum "), 1_000_000), F.lit("bluebird")).alias("text"))
    listed = spark.createDataFrame([("blue",), ("ipsum lorem",), ("red",)], "term string")
    assert {r.term for r in curation.substrings_in(rows, listed).collect()} == {"blue", "ipsum lorem"}


# ---- patterns over very long texts


def test_amounts_in_a_long_list(spark):
    """A list of a million numbers is one literal, and no recursion."""
    rows = spark.range(1).select(F.concat(F.repeat(F.lit("12,"), 1_000_000), F.lit("5 kip and 1,234.50 or ກີບ 7")).alias("t")).select(texts.amounts(F.col("t")).alias("a")).first()
    assert len(rows.a) == 3 and rows.a[0].endswith("12,5 kip") and len(rows.a[0]) == 3_000_005 and rows.a[1:] == ["1,234.50", "ກີບ 7"]
