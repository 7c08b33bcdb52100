"""Chunkers and parsers against plain versions."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from sheafmill.operators import chunking, ingest
from sheafmill.sources import files, markdown


def test_sentence_spans():
    """Each span can't take one more sentence, and steps back by the shortest tail that reaches the overlap, but goes forward."""
    random.seed(1)
    for _ in range(500):
        counts = [random.randint(1, 12) for _ in range(random.randint(0, 30))]
        most = random.randint(1, 20)
        overlap = random.randrange(most)
        spans = chunking.sentence_spans(counts, most, overlap)
        assert (not counts and not spans) or (spans[0][0] == 0 and spans[-1][1] == len(counts))
        for low, high in spans:
            assert high == low + 1 or sum(counts[low:high]) <= most
            assert high == len(counts) or sum(counts[low : high + 1]) > most
        for (low, high), (after, further) in zip(spans, spans[1:], strict=False):
            assert low < after <= high <= further
            assert after == low + 1 or sum(counts[after:high]) >= overlap
            assert after == high or sum(counts[after + 1 : high]) < overlap


def test_block_spans_cover_and_go_forward():
    random.seed(2)
    for _ in range(500):
        counts = [random.randint(0, 12) for _ in range(random.randint(1, 30))]
        spans = chunking.block_spans(counts, 20, 6)
        assert spans[0][0] == 0 and spans[-1][1] == len(counts)
        assert all(a < c <= b < d for (a, b), (c, d) in zip(spans, spans[1:], strict=False))


def test_chunked_blocks():
    block = lambda kind, text, tokens, path=("h",), **meta: {"kind": kind, "text": text, "tokens": tokens, "path": list(path), "meta": meta}
    made = chunking.chunked_blocks([
        block("heading", "H", 1), block("prose", "a", 200, x=1), block("list", "b", 150, x=2), block("prose", "c", 100), block("table", "t", 900), block("table", "u", 1), block("prose", "d", 5),
        block("prose", "e", 5, ("other",))])
    assert [(c["kind"], c["content"], c["token_count"]) for c in made] == [("prose", "a\nb", 350), ("prose", "b\nc", 250), ("table", "t", 900), ("table", "u", 1), ("prose", "d", 5), ("prose", "e", 5)]
    assert made[0]["meta"] == {"x": 2}


TEXT = """---
title: t
---
# One #
para > x
next
Set
---
> quoted
- item
  goes on
1. other

| a | b\\|c |
|---|:-:|
| 1 | 2 |

not | a table
```py
# code
```
***
#### Deep
~~~
open"""


def test_markdown():
    found = [(b["kind"], b["text"], b["level"], b["path"]) for b in markdown.blocks_of(TEXT)]
    assert found == [
        ("heading", "One", 1, ["One"]), ("heading", "para > x next Set", 2, ["One", "para > x next Set"]), ("prose", "quoted", None, ["One", "para > x next Set"]),
        ("list", "item\ngoes on", 0, ["One", "para > x next Set"]), ("list", "other", 0, ["One", "para > x next Set"]), ("table", "| a | b\\|c |\n|---|:-:|\n| 1 | 2 |", None, ["One", "para > x next Set"]),
        ("prose", "not | a table", None, ["One", "para > x next Set"]), ("prose", "# code", None, ["One", "para > x next Set"]), ("heading", "Deep", 4, ["One", "para > x next Set", "", "Deep"]), ("prose", "open", None, ["One", "para > x next Set", "", "Deep"])]
    assert markdown.blocks_of("") == [] and markdown.blocks_of(None) == []


def test_entry_blocks(spark):
    body = "intro\nmore\n\n# A\n### C\n| x\n| y\ntext\n## B\n##### five\n"
    rows = markdown.entry_blocks(spark.createDataFrame([(1, "T", body), (2, "T", None)], "doc_id long, title string, body string")).orderBy("doc_id", "block_no").collect()
    assert [(r.kind, r.text, r.path) for r in rows if r.doc_id == 1] == [
        ("prose", "intro\nmore", ["T"]), ("heading", "A", ["T", "A"]), ("heading", "C", ["T", "A", "C"]), ("table", "| x\n| y", ["T", "A", "C"]), ("prose", "text", ["T", "A", "C"]), ("heading", "B", ["T", "A", "B"]),
        ("prose", "##### five", ["T", "A", "B"])]
    assert not [r for r in rows if r.doc_id == 2]


def test_decoding():
    text = "ສະບາຍດີ hello"
    assert files.decoded(text.encode()) == text and files.decoded(b"\xef\xbb\xbf" + text.encode()) == text
    for order in ("le", "be"):
        raw = "plain words".encode(f"utf-16-{order}")
        assert files.decoded({"le": b"\xff\xfe", "be": b"\xfe\xff"}[order] + raw) == "plain words"
    assert files.decoded("plain words".encode("utf-16-le")) == "plain words"  # without a mark, little-endian wins ties
    assert files.decoded(b"\xff\x80\x81\x82abc") is None


def docx(body, **parts):
    held = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        for name, inner in parts.items():
            z.writestr(f"word/{name}.xml", f"<w:{name} {ns}>{inner}</w:{name}>")
    return held.getvalue()


def test_docx(spark, tmp_path):
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"
    body = (
        p("Top", '<w:pStyle w:val="Title"/>') + p("Two", '<w:pStyle w:val="berschrift2"/>') + p("item", '<w:numPr><w:ilvl w:val="1"/></w:numPr>') + "<w:p><w:r><w:t>kept </w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:t>old</w:t></w:r></w:del></w:p>"
        + f"<w:tbl><w:tr>{cell('a', '<w:gridSpan w:val=\"2\"/>')}{cell('b', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('c')}{cell('d|e')}{cell('', '<w:vMerge/>')}</w:tr></w:tbl>" + p(""))
    styles = '<w:style w:styleId="berschrift2"><w:name w:val="heading 2"/></w:style>'
    raw = docx(body, styles=styles, footnotes='<w:footnote w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote>')
    (tmp_path / "x.docx").write_bytes(raw)
    row = files.docx_files(spark, str(tmp_path)).first()
    assert [(b.kind, b.text, b.path) for b in row.blocks] == [
        ("heading", "Top", ["Top"]), ("heading", "Two", ["Top", "Two"]), ("list", "item", ["Top", "Two"]), ("prose", "kept new", ["Top", "Two"]), ("table", "| a |  | b |\n|---|---|---|\n| c | d\\|e |  |", ["Top", "Two"])]
    assert row.notes == ["note"] and row.warnings == [] and row.blocks[2].level == 1
    assert (row.stats["tables"], row.stats["insertions"], row.stats["deletions"]) == (1, 1, 1)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code,name\n101, "say ""hi"", ok" \n,\n', encoding="utf-8")
    assert [tuple(r) for r in files.csv_rows(spark, str(tmp_path / "a.csv")).collect()] == [("101", 'say "hi", ok')]
    (tmp_path / "a.jsonl").write_text('{"q": "x"}\nbad\n')
    assert sorted((r.q or "", r._corrupt_record or "") for r in files.jsonl_rows(spark, str(tmp_path / "a.jsonl"), "q string").collect()) == [("", "bad"), ("x", "")]
    lint = spark.createDataFrame([("p", "ok\nauthority: TODO\nfill ____ in\nDRAFT text")], "path string, text string")
    assert [(r.line_no, r.problem) for r in files.template_problems(lint).orderBy("line_no").collect()] == [(2, "authority"), (3, "blank"), (4, "draft")]
    assert files.synthetic_vectors(spark, 3, 8).select(F.size("embedding").alias("n")).first().n == 8


def test_entries_saved(spark):
    """Entries are created, then one is updated: its chunks are replaced, those of others stay; an entry without text keeps its row and has no chunk."""
    schema = "id long, title string, body string, kind string, collection string"
    entries = spark.createDataFrame([(1, "Tax", "# VAT\nten percent\n\n| a | b |\n|---|---|\n| 1 | 2 |", "rate", "tax"), (2, "Empty", " \n", "note", "sop"), (3, "Third", "plain", "note", "sop")], schema)
    nothing = ingest.entry_chunks(entries.where("false"))
    first = ingest.entries_saved(entries, spark.createDataFrame([], "id long, title string, collection string, meta string"), nothing)
    chunks = [(r.doc_id, r.seq, r.kind, r.content, r.path, r.review, r.meta) for r in first.chunks.orderBy("doc_id", "seq").collect()]
    rate, note = ('{"manual":true,"knowledge_kind":"%s"}' % k for k in ("rate", "note"))
    assert chunks == [(1, 0, "prose", "ten percent", ["Tax", "VAT"], "accepted", rate), (1, 1, "table", "a b\n1 2", ["Tax", "VAT"], "accepted", rate), (3, 0, "prose", "plain", ["Third"], "accepted", note)]
    assert {r.id: r.event_type for r in first.events.collect()} == dict.fromkeys((1, 2, 3), "knowledge.created") and sorted(r.id for r in first.jobs.collect()) == [1, 3]
    again = ingest.entries_saved(spark.createDataFrame([(1, "Tax", "new", "rate", "tax")], schema), first.documents, first.chunks)
    assert sorted((r.doc_id, r.content) for r in again.chunks.collect()) == [(1, "new"), (3, "plain")]
    assert again.documents.count() == 3 and [(r.id, r.event_type) for r in again.events.collect()] == [(1, "knowledge.updated")]


def test_block_counts_are_made_once_a_document(spark):
    """The counts of a document's blocks aren't made anew for each of its blocks, which would take the square of their number."""
    blocks = [("heading" if i % 50 == 0 else "prose", f"block {i} text", ["top"]) for i in range(300)]
    docs = spark.createDataFrame([(1, blocks), (2, []), (3, blocks[:2])], "doc_id long, blocks array<struct<kind: string, text: string, path: array<string>>>")
    made = chunking.block_chunks(docs, 30, 3)
    assert "[lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = chunking.chunked_blocks([{"kind": k, "text": t, "tokens": 3, "path": p} for k, t, p in blocks], 30, 3)
    assert [(r.seq, r.kind, r.content, r.token_count, r.path) for r in made.where("doc_id = 1").orderBy("seq").collect()] == [(c["seq"], c["kind"], c["content"], c["token_count"], c["path"]) for c in want]
    assert [r.content for r in made.where("doc_id > 1").collect()] == ["block 1 text"]


def test_texts_without_marks_stay_as_they_are(spark):
    from sheafmill.functions import texts

    said = ["", None, "a  b\tc", "x\u200by", "\u0e81\u0eb1\u0eb1", "\u0e81 \u0eb1", "\u0eb1 \u200d\u0eb1", "\ufeff", "plain\n text"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select(texts.defects_fixed(F.col("t")).alias("one"), texts.defects_fixed(F.col("t"), 2).alias("two"))
    assert [tuple(r) for r in rows.collect()] == [("", ""), (None, None), ("a  b\tc",) * 2, ("xy", "xy"), ("\u0e81\u0eb1",) * 2, ("\u0e81\u0eb1",) * 2, ("\u0eb1\u0eb1", "\u0eb1"), ("", ""), ("plain\n text",) * 2]
