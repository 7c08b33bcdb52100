"""Prefix trie, fill-in-middle and digest index against brute force, on odd tables and over several batches."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sheafmill.llm import common, op11_trie, op12_middle, op13_exact

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- op11


def brute_trie(rows):
    """Nodes by (conv_id, depth), from rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in own:
        heads = zlib.crc32(str(c).encode()) % 6
        base = int(c - (abs(c) % 100) * (1 if c > 0 else -1))
        said = tuple(own.get(base, [])[:heads] + own[c][heads:])
        for d in range(len(said) + 1):
            members[said[:d]].add(c)
        ends[said].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    below = collections.defaultdict(lambda: [0, 0])
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]][0] += not children[k]
            below[k[:d]][1] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], *below[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()
    )


def spark_trie(spark, rows):
    table = spark.createDataFrame(rows, TURNS)
    for clash in ("n", "place", "k1", "base", "heads", "chars", "last", "turn_hash"):
        table = table.withColumn(clash, F.lit("clash"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs, turns = op11_trie.rebuilt(op11_trie.turns_of(table), F.col("conv_id") - F.col("conv_id") % 100, heads, 5)
    return sorted(tuple(r) for r in op11_trie.trie(convs, turns).drop("k1", "k2").collect())


def conversations(seed, n, longest):
    pick = random.Random(seed)
    rows = []
    for c in (pick.randrange(-150, 350) for _ in range(n)):
        for turn in range(pick.choice((1, 2, 3, 7, longest))):
            rows.append((c, pick.choice((turn, turn, None)), pick.choice(("user", "assistant", "", None)), pick.choice(("a", "b", "é𝄞", "", None, "long " * 40))))
    return [*rows, *rows[:3], (None, 1, "user", "of nobody")]


@pytest.mark.parametrize(("band", "longest"), [(16, 40), (3, 30), (2, 9)])
def test_trie_by_brute_force(spark, monkeypatch, band, longest):
    """Of several levels of bands as well."""
    monkeypatch.setattr(op11_trie, "BAND", band)
    rows = conversations(band, 40, longest)
    assert spark_trie(spark, rows) == brute_trie(rows)


def test_trie_of_copies(spark, monkeypatch):
    """One conversation is a third of all, and one has a third of all turns."""
    monkeypatch.setattr(op11_trie, "BAND", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 60) for t in range(4)] + [(100, t, "user", f"turn {t}") for t in range(120)] + [(c, 0, "user", f"own {c}") for c in range(200, 320)]
    assert spark_trie(spark, rows) == brute_trie(rows)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in common.load(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in op11_trie.op11_prefix_trie(spark, SF).collect()) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert spark_trie(spark, []) == [] == spark_trie(spark, [(None, 1, "user", "x")])


# ---- op12


UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


@pytest.mark.parametrize("seed", range(4))
def test_skip_list_by_brute_force(seed):
    """Every rank, with few and many lanes and slices that cut code points."""
    pick = random.Random(seed)
    for length in (0, 1, 2, 17, 400):
        text = "".join(pick.choice("abcXYZ  \n\té日𝄞@[`{0") for _ in range(length))
        units = UNITS.findall(text)
        made = op12_middle.UnitList(text.encode(), lane_bits=pick.choice((1, 2, 4)), slice_bytes=pick.choice((1, 3, 64, 1 << 20)))
        assert (made.n_units, made.n_points) == (len(units), len(text))
        for rank in range(len(units) + 1):
            head = "".join(units[:rank])
            assert made.after(rank) == (len(head), len(head.encode()))


def test_skip_list_descends():
    """A cut in a million units passes some tens of nodes, and lanes thin out."""
    made = op12_middle.UnitList(b"ab " * 500_000)
    assert made.after(777_777) == (777_777 // 2 * 3 + 2, 777_777 // 2 * 3 + 2)
    assert [len(lane.units) for lane in made.lanes] == sorted((len(lane.units) for lane in made.lanes), reverse=True)
    assert len(made.lanes[0].units) < 100_000 and len(made.lanes[-1].units) < 20 and all(lane.units.sum() == 1_000_000 and lane.points.sum() == 1_500_000 for lane in made.lanes)


ODD = [
    (1, "hello world, it's é日𝄞!", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "with <S> inside", "en", "a", 2), (5, " \n\t", "en", None, 3), (None, "row without key", "fr", "b", 4),
    (6, "x" * 100_000, "en", "a", 5), (7, "<", "en", "a", 6), (7, "<", "en", "a", 6), (7, "other text of the id", "en", "a", 6), (8, "ends with <S", "en", "a", 7), (9, "word " * 60_000, "en", "a", 8), *[(100 + k, f"text {k} " * 5, "en", "a", 9) for k in range(80)],
]


def odd(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for clash in ("n", "form", "output", "prefix_chars", "digest", "row", "keep_id", "kept", "batch", "top_id"):
        docs = docs.withColumn(clash, F.lit("clash"))
    return docs


def test_fill_in_middle_by_brute_force(spark):
    rows = op12_middle.transformed(odd(spark, ODD)).select("doc_id", "text", "_sm_fim.*", op12_middle.restored(F.col("_sm_fim.output"), F.col("_sm_fim.form")).alias("back")).collect()
    assert len(rows) == len(ODD) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = r.text or ""
        units, digest = UNITS.findall(text), hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        assert (r.n, r.back) == (len(units), text)
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            assert (r.form, r.output, r.prefix_chars, r.middle_chars) == ("plain", text, None, None)
        else:
            form = "spm" if h[3] % 100 < 20 else "psm"
            assert (r.form, r.output, r.prefix_chars, r.middle_chars) == (form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_fill_in_middle_of_nothing(spark):
    assert op12_middle.transformed(odd(spark, [])).count() == 0


def test_fill_in_middle_runs_once(spark):
    """One pass through Python, whatever is read of its result."""
    plan = op12_middle.op12_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


# ---- op13


def folded(text):
    return (text or "").translate({ord(a): ord(b) for a, b in zip(op13_exact.UPPER, op13_exact.LOWER, strict=True)})


COPIES = [
    (1, "Same", "en", "a", 1), (5, "sAME", "en", "a", 1), (3, "same", "en", "a", 1), (4, None, None, None, None), (2, "", "en", "a", 0), (9, "alone É", "en", "a", 1), (10, "alone é", "en", "a", 1),
    (7, "twice", "en", "a", 1), (7, "twice", "en", "a", 1), (None, "no key", "en", "a", 1), (None, "NO KEY", "en", "a", 1), (None, "same", "en", "a", 1), (11, "x" * 100_000, "en", "a", 1), (12, "X" * 100_000, "en", "a", 1),
]


def test_exact_dedup_by_brute_force(spark):
    index = op13_exact.DigestIndex(spark, common.fresh_path(spark, "test-index"), 4)
    rows = op13_exact.deduplicated(odd(spark, COPIES), index, "one").collect()
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in COPIES:
        groups[hashlib.sha256(folded(text).encode()).digest()].append(doc_id)
    want = collections.Counter((doc_id, bytes(digest), max((i for i in ids if i is not None), default=None), len(ids)) for digest, ids in groups.items() for doc_id in ids)
    assert collections.Counter((r.doc_id, bytes(r.digest), r.keep_id, r.group_size) for r in rows) == want
    assert sorted(bytes(r.digest) for r in rows if r.kept) == sorted(groups) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert index.rows().count() == len(groups)


def test_index_over_batches(spark):
    """An index that is opened again knows what earlier batches brought; a batch that is added again changes nothing."""
    path, docs = common.fresh_path(spark, "test-index"), odd(spark, COPIES)
    first = op13_exact.filtered(docs.where("doc_id < 5"), op13_exact.DigestIndex(spark, path, 4), "first")
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == [3, 4]
    again = op13_exact.DigestIndex(spark, path, 99)
    assert again.buckets == 4 and again.rows().count() == 2
    later = op13_exact.filtered(docs, again, "second")
    assert sorted(str(r.doc_id) for r in later.collect()) == ["10", "12", "7", "9", "None"]
    assert sorted(str(r.doc_id) for r in op13_exact.filtered(docs, again, "second").collect()) == ["10", "12", "7", "9", "None"]
    assert op13_exact.filtered(docs, again, "third").count() == 0
    assert op13_exact.filtered(odd(spark, []), again, "empty").count() == 0 and again.rows().count() == 7
    copy = again.rebuilt(common.fresh_path(spark, "test-index"), 8)
    assert copy.buckets == 8 and sorted(map(tuple, copy.rows().collect())) == sorted(map(tuple, again.rows().collect()))


def test_index_is_not_shuffled(spark):
    """The anti-join is by sort and merge, and shuffles the new groups alone."""
    index = op13_exact.DigestIndex(spark, common.fresh_path(spark, "test-index"), 4)
    groups = op13_exact.grouped(op13_exact.digested(odd(spark, COPIES)))
    index.add(groups, "one")
    plan = index.unknown(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan


def test_index_files_are_sorted_buckets(spark):
    """A file a bucket and batch, each in order of digests."""
    index = op13_exact.DigestIndex(spark, common.fresh_path(spark, "test-index"), 4)
    index.add(op13_exact.grouped(op13_exact.digested(common.load(spark, SF, "documents"))), "one")
    files = collections.defaultdict(list)
    for r in spark.read.parquet(f"{index.path}/digests").select(F.input_file_name().alias("file"), "digest").coalesce(1).collect():
        files[r.file].append(bytes(r.digest))
    assert len(files) == 4 and all(x == sorted(x) for x in files.values())
