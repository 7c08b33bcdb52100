"""Files that are what their manifest says, typed JSON merges, and suggestions by deletions."""

import hashlib
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from sheafmill.operators import curation, export, lifecycle


def lines(spark, n=200):
    rows = [(i, ("train", "dev", "a b/ü")[i % 3], f"text é {i} " * (i % 5) if i % 11 else None) for i in range(n)]
    table = spark.createDataFrame(rows, "id long, split string, content string")
    return export.lines(table, ["id", "content"], F.col("split")), rows


@pytest.mark.parametrize("part_bytes", [1 << 26, 700])
def test_files_are_what_their_manifest_says(spark, tmp_path, part_bytes):
    """Each file, as sha256sum would read it; in one part or in several."""
    made, rows = lines(spark)
    said = {(r.file, r.part): r for r in export.write(made.repartition(5), f"file://{tmp_path}", "1.2.3", part_bytes).collect()}
    assert {k: tuple(v) for k, v in said.items()} == {(r.file, r.part): tuple(r) for r in export.manifest(made, part_bytes).collect()}
    files = list(pathlib.Path(tmp_path).rglob("*.txt"))
    assert len(files) == len(said) and (len(said) == 3) == (part_bytes > 700)
    whole = {}
    for f in files:
        body = f.read_bytes()
        r = next(r for r in said.values() if r.sha256 == hashlib.sha256(body).hexdigest())
        assert (r.bytes, r.records) == (len(body), body.count(b"\n")) and r.bytes <= part_bytes + 200
        whole[r.file, r.part] = [json.loads(x) for x in body.decode().splitlines()]
    for name in ("train", "dev", "a b/ü"):
        got = [x for k in sorted(whole) if k[0] == name for x in whole[k]]
        assert got == [{"id": i, "content": text} for i, split, text in rows if split == name]
    with pytest.raises(Exception, match="already exists"):
        export.write(made, f"file://{tmp_path}", "1.2.3")


def test_a_changed_file_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "digested", lambda batches: (b.iloc[:1].assign(records=1, bytes=1, sha256="0" * 64)[["file", "part", "records", "bytes", "sha256"]] for b in batches))
    with pytest.raises(OSError, match="differs"):
        export.write(lines(spark, 3)[0], f"file://{tmp_path}", "1.0.0")


def test_no_lines(spark, tmp_path):
    assert export.write(lines(spark)[0].where("false"), f"file://{tmp_path}", "1.0.0").count() == 0


def test_merged_json_keeps_types(spark):
    rows = [(1, '{"k":87,"a":{"b":[1,true,null,"x"]},"s":"87"}'), (2, None), (3, "no json"), (4, '{"reported":"old","n":1.5}'), (5, '{"k":1}'), (6, "{}"), (7, "[1]")]
    table = spark.createDataFrame(rows, "id long, props string")
    merge = lambda value: {r.id: json.loads(r.props) if r.id != 5 else r.props for r in lifecycle.json_merged(table, table.where("id <> 5"), "id", "props", "reported", value).collect()}
    assert merge(True) == {1: {"k": 87, "a": {"b": [1, True, None, "x"]}, "s": "87", "reported": True}, 2: {"reported": True}, 3: {"reported": True}, 4: {"n": 1.5, "reported": True}, 5: '{"k":1}', 6: {"reported": True}, 7: {"reported": True}}
    assert merge({"by": [1, None]})[6] == {"reported": {"by": [1, None]}} and merge("x'\"")[6] == {"reported": "x'\""}


def edits(word, letters):
    splits = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in splits if b} | {a + b[1] + b[0] + b[2:] for a, b in splits if len(b) > 1} | {a + c + b[1:] for a, b in splits if b for c in letters} | {a + c + b for a, b in splits for c in letters}


@pytest.mark.parametrize("seed", range(3))
def test_suggestions_by_brute_force(spark, seed):
    """Those of the neighbourhood, on words of few letters, where nearly all are near."""
    pick = random.Random(seed)
    make = lambda n, letters: sorted({"".join(pick.choices(letters, k=pick.randint(1, 5))) for _ in range(n)})
    words, known = make(60, "abcz"), make(80, "abcz")
    got = {r.word: (r.in_dictionary, r.suggestions) for r in curation.spell_checked(*(spark.createDataFrame([(w,) for w in x], "word string") for x in (words, known)), "abc", most=99).collect()}
    assert got == {w: (True, []) if w in known else (False, sorted((edits(w, "abc") & set(known)) - {w})) for w in words}


def test_stored_deletions(spark):
    known = spark.createDataFrame([("bluebird",), ("blue",)], "word string")
    cuts = curation.deletions(known)
    assert {(r.word, r.cut) for r in cuts.where("word = 'blue'").collect()} == {("blue", c) for c in ("blue", "lue", "bue", "ble", "blu")}
    got = curation.spell_checked(spark.createDataFrame([("bleu",), ("bluebrid",), ("x",)], "word string"), known, "abcdefghijklmnopqrstuvwxyz", cuts=cuts).collect()
    assert {r.word: r.suggestions for r in got} == {"bleu": ["blue"], "bluebrid": ["bluebird"], "x": []}
