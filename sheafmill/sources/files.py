"""File sources: CSV and JSONL templates, text of unknown encoding, Word documents, template lint."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafmill.functions import texts
from sheafmill.sources.markdown import BLOCKS

# The namespace and element names of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DROPPED = (f"{W}del", f"{W}moveFrom")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A template's rows as trimmed strings, quotes doubled inside quotes, without blank rows."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in rows.columns])
    return rows.where(F.concat_ws("", *[F.col(f"`{c}`") for c in rows.columns]) != "")


def jsonl_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects a line; lines that aren't such are kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def token_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep ..., response, done) of a model's stream of JSON lines (value), batch or streaming; lines that aren't such are left out."""
    read = lines.where("trim(value) <> ''").select(*keep, F.from_json("value", "response string, done boolean").alias("x"))
    return read.where("x.response IS NOT NULL OR x.done IS NOT NULL").select(*keep, F.coalesce("x.response", F.lit("")).alias("response"), F.coalesce("x.done", F.lit(False)).alias("done"))


def source_kind(path: F.Column) -> F.Column:
    return F.when(path.rlike("(?i)\\.(md|markdown)$"), "markdown").when(path.rlike("(?i)\\.docx$"), "docx").otherwise("other")


def decoded(raw: bytes) -> str | None:
    """Text of bytes: UTF-8, or UTF-16 by its mark or by many NUL characters; None if over a twentieth can't be read."""
    def score(text: str) -> int:
        return text.count("\ufffd") + text.count("\0")

    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = raw[2:].decode("utf-16-le" if raw[:1] == b"\xff" else "utf-16-be", "replace")
    else:
        text = raw.decode("utf-8", "replace")
        if text.count("\0") > len(text) / 8:
            text = min((raw.decode(f"utf-16-{e}", "replace") for e in ("le", "be")), key=score)
    text = text.removeprefix("\ufeff").replace("\0", "")
    return None if text.count("\ufffd") > len(text) / 20 else text


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, text) of files of any of the known encodings."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "sha256": batch["sha256"], "text": [decoded(c) for c in batch["content"]]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(decode, "path string, sha256 string, text string")


def run_text(node: ElementTree.Element) -> str:
    """Text of a paragraph or cell with its tracked changes accepted."""
    out = []
    for child in node:
        if child.tag in DROPPED:
            continue
        if child.tag == f"{W}t":
            out.append(child.text or "")
        elif child.tag in (f"{W}tab", f"{W}br"):
            out.append("\t" if child.tag == f"{W}tab" else "\n")
        else:
            out.append(run_text(child))
    return "".join(out)


def value_of(node: ElementTree.Element | None, *path: str) -> str | None:
    """The w:val at a path of elements below a node; None if the path isn't there, and empty if it has no value."""
    for tag in path:
        node = None if node is None else node.find(W + tag)
    return None if node is None else node.get(f"{W}val", "")


def paragraph(node: ElementTree.Element, styles: dict[str, str]) -> dict:
    """A paragraph's kind by its style's name: headings by the first number in it (1 without one), lists with their level."""
    style_id = value_of(node, "pPr", "pStyle") or ""
    style = styles.get(style_id, style_id).strip().lower()
    listed = node.find(f"{W}pPr/{W}numPr") is not None
    text = run_text(node).strip()
    if style == "title" or style.startswith("heading"):
        number = re.search(r"\d+", style)
        return {"kind": "heading", "text": text, "level": int(number[0]) if number else 1}
    if listed or style.replace(" ", "") == "listparagraph":
        return {"kind": "list", "text": text, "level": int(value_of(node, "pPr", "numPr", "ilvl") or 0)}
    return {"kind": "prose", "text": text, "level": None}


def table_cells(node: ElementTree.Element) -> list[list[str]]:
    """Cells of a table. A merged cell's value stands once, at its top left; the other places that it covers are empty."""
    def row(tr: ElementTree.Element) -> Iterator[str]:
        for tc in tr.findall(f"{W}tc"):
            covered = value_of(tc, "tcPr", "vMerge") not in (None, "restart")
            lines = (run_text(p).strip() for p in tc.findall(f"{W}p"))
            yield "" if covered else "\n".join(filter(None, lines))
            span = value_of(tc, "tcPr", "gridSpan") or "1"
            yield from [""] * (int(span) - 1 if span.isdigit() else 0)

    return [list(row(tr)) for tr in node.findall(f"{W}tr")]


def docx_stats(body: ElementTree.Element) -> tuple[dict[str, int], list[str]]:
    """Counts of a document's parts and of its tracked changes, and warnings about what the blocks don't show."""
    count = lambda *tags: sum(1 for x in body.iter() if x.tag in {W + t for t in tags})
    stats = {"paragraphs": count("p"), "tables": count("tbl"), "insertions": count("ins", "moveTo"), "deletions": count("del", "moveFrom")}
    warned = {"nested tables are part of their cell": any(x.find(f".//{W}tbl") is not None for x in body.iter(f"{W}tc")), "pictures are left out": count("drawing", "pict") > 0, "text boxes are read in line": count("txbxContent") > 0}
    return stats, [text for text, so in warned.items() if so]


def docx_blocks(raw: bytes) -> tuple[list[dict], list[str], dict[str, int], list[str]]:
    """Blocks of a Word document in order, its foot- and endnotes, counts and warnings."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
        styles = {}
        if "word/styles.xml" in archive.namelist():
            styles = {x.get(f"{W}styleId", ""): value_of(x, "name") or "" for x in ElementTree.fromstring(archive.read("word/styles.xml")).findall(f"{W}style")}
        notes = []
        for name, tag in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
            if name in archive.namelist():
                notes += [run_text(n).strip() for n in ElementTree.fromstring(archive.read(name)).findall(f"{W}{tag}") if n.get(f"{W}id") not in ("0", "-1")]
    blocks, path = [], []
    for node in body if body is not None else []:
        if node.tag == f"{W}p":
            block = paragraph(node, styles)
            if block["kind"] == "heading" and block["text"]:
                path = [*path[: block["level"] - 1], *[""] * (block["level"] - 1 - len(path)), block["text"]]
        elif node.tag == f"{W}tbl":
            rows = table_cells(node)
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
            block = {"kind": "table", "text": "\n".join([*lines[:1], "|" + "---|" * width, *lines[1:]]), "level": None}
        else:
            continue
        if block["text"]:
            blocks.append(block | {"path": list(path)})
    stats, warnings = docx_stats(body) if body is not None else ({}, ["there is no body"])
    return blocks, [n for n in notes if n], stats, warnings


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, blocks, notes, stats, warnings) of Word documents."""
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [docx_blocks(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "sha256": batch["sha256"], "blocks": [f[0] for f in found], "notes": [f[1] for f in found], "stats": [f[2] for f in found], "warnings": [f[3] for f in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("blocks", BLOCKS), T.StructField("notes", T.ArrayType(T.StringType())), T.StructField("stats", T.MapType(T.StringType(), T.IntegerType())), T.StructField("warnings", T.ArrayType(T.StringType()))])
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(extract, schema)


def text_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, line_no, line) of all files below a folder whose names fit."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return lines.select("path", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def template_problems(files: DataFrame) -> DataFrame:
    """(path, line_no, problem) of template texts (path, text): blank marks, draft notes, authority left open."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    authority = F.regexp_extract("line", "^authority:\\s*(.*)$", 1)
    problem = F.when(F.col("line").contains("____"), "blank").when(F.col("line").rlike("(?i)\\bdraft\\b"), "draft").when(F.col("line").rlike("^authority:") & ((F.trim(authority) == "") | authority.rlike("(?i)todo")), "authority")
    return lines.withColumn("problem", problem).where("problem IS NOT NULL").select("path", (F.col("n") + 1).cast("long").alias("line_no"), "problem")


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, n, url, title) of a page's links, redirect parameters resolved."""
    found = F.regexp_extract_all(F.col(html), F.lit('(?is)<a\\b[^>]*?href="[^"]+"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("n", "a"))
    href = F.regexp_extract("a", '(?is)href="([^"]+)"', 1)
    target = F.regexp_extract(href, "[?&]uddg=([^&]+)", 1)
    url = F.when(target != "", F.try_url_decode(target)).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    return rows.select(key, F.col("n").cast("long").alias("n"), url.alias("url"), texts.tags_stripped(F.col("a")).alias("title"))


def synthetic_vectors(spark: SparkSession, n: int, dims: int = 1024, seed: int = 1) -> DataFrame:
    """(id, embedding) of random vectors, for load tests."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(2_000_001)) / F.lit(1e6) - 1.0).cast("float")).alias("embedding"))
