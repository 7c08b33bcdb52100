"""Markdown as typed blocks: the grammar of ingested files, and the smaller one of authored entries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafmill.functions import texts

BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType()))]))

# The line grammar.
ATX = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*")
SETEXT = re.compile(r"\s*(=+|-+)\s*")
RULE = re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*")
FENCE = re.compile(r"\s*(`{3,}|~{3,})")
ITEM = re.compile(r"(\s*)(?:[-*+]|\d{1,9}[.)])\s+(\S.*)")
QUOTE = re.compile(r"\s*(?:>\s?)+")
CELL_RULE = re.compile(r":?-+:?")
CELL_MARK = re.compile(r"(?<!\\)\|")


def cells_of(line: str) -> list[str]:
    bare = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.replace("\\|", "|").strip() for c in CELL_MARK.split(bare)]


class Parser:
    """Reads lines by rules, tried in order at each place; what no rule takes is paragraph text."""

    def __init__(self, text: str):
        self.lines = re.split(r"\r\n|\r|\n", text)
        self.blocks: list[dict] = []
        self.path: list[str] = []
        self.held: list[str] = []
        self.at = self.after_front_matter()

    def after_front_matter(self) -> int:
        marks = [i for i, line in enumerate(self.lines) if line.strip() == "---"]
        return marks[1] + 1 if len(marks) > 1 and marks[0] == 0 else 0

    def put(self, kind: str, text: str, level: int | None = None) -> None:
        self.blocks.append({"kind": kind, "text": text, "level": level, "path": list(self.path)})

    def close(self) -> None:
        text, self.held = "\n".join(self.held).strip(), []
        if text:
            self.put("prose", text)

    def head(self, level: int, text: str) -> None:
        self.path = [*self.path[: level - 1], *[""] * (level - 1 - len(self.path)), text]
        self.put("heading", text, level)

    def until(self, start: int, stop: Callable[[str], object]) -> int:
        return next((i for i in range(start, len(self.lines)) if stop(self.lines[i])), len(self.lines))

    def fence(self, line: str) -> int | None:
        if not (m := FENCE.match(line)):
            return None
        self.close()
        end = self.until(self.at + 1, re.compile(rf"\s*[{m[1][0]}]{{{len(m[1])},}}\s*").fullmatch)
        if body := "\n".join(self.lines[self.at + 1 : end]).strip():
            self.put("prose", body)
        return end + 1

    def blank(self, line: str) -> int | None:
        if line.strip():
            return None
        self.close()
        return self.at + 1

    def atx(self, line: str) -> int | None:
        if not (m := ATX.fullmatch(line)):
            return None
        self.close()
        if m[2].strip():
            self.head(len(m[1]), m[2].strip())
        return self.at + 1

    def setext(self, line: str) -> int | None:
        if not self.held or not (m := SETEXT.fullmatch(line)):
            return None
        text, self.held = " ".join(self.held).strip(), []
        self.head(1 if m[1][0] == "=" else 2, text)
        return self.at + 1

    def rule(self, line: str) -> int | None:
        if not RULE.fullmatch(line):
            return None
        self.close()
        return self.at + 1

    def table(self, line: str) -> int | None:
        if "|" not in line:
            return None
        end = self.until(self.at, lambda x: not x.strip() or "|" not in x)
        if end - self.at < 2 or not all(map(CELL_RULE.fullmatch, cells_of(self.lines[self.at + 1]))):
            return None
        self.close()
        self.put("table", "\n".join(x.strip() for x in self.lines[self.at : end]))
        return end

    def item(self, line: str) -> int | None:
        if not (m := ITEM.fullmatch(line)):
            return None
        self.close()
        goes_on = lambda x: x.strip() and re.match(r"\s{2,}", x) and not (ITEM.fullmatch(x) or ATX.fullmatch(x) or FENCE.match(x))
        end = self.until(self.at + 1, lambda x: not goes_on(x))
        self.put("list", "\n".join([m[2].strip(), *(x.strip() for x in self.lines[self.at + 1 : end])]), len(m[1].replace("\t", "  ")) // 2)
        return end

    def parsed(self) -> list[dict]:
        rules = (self.fence, self.blank, self.atx, self.setext, self.rule, self.table, self.item)
        while self.at < len(self.lines):
            line = self.lines[self.at]
            after = next((n for r in rules if (n := r(line)) is not None), None)
            if after is None:
                self.held.append(QUOTE.sub("", line, count=1) if QUOTE.match(line) else line)
            self.at = self.at + 1 if after is None else after
        self.close()
        return self.blocks


def blocks_of(text: str | None) -> list[dict]:
    return Parser(text).parsed() if text else []


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blocks) of each document by the grammar of ingested files."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "blocks": [blocks_of(t) for t in batch[text]]})

    return docs.select(key, text).mapInPandas(parse, T.StructType([T.StructField(key, T.LongType()), T.StructField("blocks", BLOCKS)]))


def entry_blocks(entries: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body") -> DataFrame:
    """(key, block_no, kind, level, text, path) of authored entries, by windows over lines: headings to level 4, any run of lines that begin with
    a pipe is a table, other runs are prose; the path is the title and the headings above."""
    lines = entries.select(key, title, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\n")).alias("n", "line"))
    mark, bare = F.regexp_extract("line", "^(#{1,4})\\s+(.*)$", 1), F.trim("line")
    kind = F.when(F.col("line").rlike("^\\s*$"), "blank").when(F.length(mark) > 0, "heading").when(bare.startswith("|"), "table").otherwise("prose")
    lines = lines.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.length(mark)))
    order = Window.partitionBy(key).orderBy("n")
    opens = (F.col("kind") == "heading") | (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit("")))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("block", F.sum(opens.cast("int")).over(so_far))
    name = F.trim(F.regexp_extract("line", "^(#{1,4})\\s+(.*)$", 2))
    for k in range(1, 5):  # the last heading of level k or above; it counts if its own level is k
        lines = lines.withColumn(f"h{k}", F.last(F.when(F.col("level") <= k, F.struct("level", name.alias("name"))), ignorenulls=True).over(so_far))
    path = F.filter(F.array(F.col(title), *[F.when(F.col(f"h{k}.level") == k, F.col(f"h{k}.name")) for k in range(1, 5)]), lambda x: x.isNotNull() & (x != ""))
    grouped = lines.where("kind <> 'blank'").groupBy(key, "block", "kind").agg(F.min("level").alias("level"), F.sort_array(F.collect_list(F.struct("n", "line"))).alias("part"), F.min_by(path, "n").alias("path"))
    text = F.array_join(F.transform("part", lambda x: x["line"]), "\n")
    text = F.when(F.col("kind") == "heading", F.trim(F.regexp_extract(text, "^(#{1,4})\\s+(.*)$", 2))).otherwise(text)
    return grouped.select(key, F.row_number().over(Window.partitionBy(key).orderBy("block")).cast("long").alias("block_no"), "kind", "level", text.alias("text"), "path")


def rendered(kind: Column, text: Column) -> Column:
    """A block's text for indexing: rows of a table without their rule line."""
    rows = F.filter(F.split(text, "\n"), lambda r: ~r.rlike("^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$"))
    return F.when(kind == "table", F.array_join(F.transform(rows, lambda r: F.array_join(texts.pipe_row(r), " ")), "\n")).otherwise(text)
