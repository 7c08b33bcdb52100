"""Text functions for bilingual (Lao and Latin) documents, as column expressions; NFC alone needs Python."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafmill.functions import batches

# Characters and words that decide results.
ZERO_WIDTH_IN_DEFECTS = "​‌‍﻿"
ZERO_WIDTH_IN_NORMAL = "\u200b-\u200d\u2060\ufeff"
LAO = "຀-໿"
LAO_DIGITS = "໐໑໒໓໔໕໖໗໘໙"
COMBINING = "ັິ-ູົຼ່-ໍ"
COMBINING_MARKS = "ັິີຶືຸູົຼ່້໊໋໌ໍ"
CURRENCY = "(?:ກີບ|ກີບ|LAK|KIP|kip|Kip|₭)"
LEGAL_FORMS = "ບໍລິສັດ|ຮ້ານ|ຈຳກັດ"
SENTENCE_ENDS = ".!?ຯ\n"

DIGITS = f"0-9{LAO_DIGITS[0]}-{LAO_DIGITS[9]}"
#: Possessive, as what comes behind begins with none of its characters: Java runs such groups without recursion, whatever their number.
NUMBER = f"[{DIGITS}]++(?:[.,][{DIGITS}]++)*+"
AMOUNT = f"(?:{NUMBER}\\s*{CURRENCY}|{CURRENCY}\\s*{NUMBER}|[{DIGITS}]{{1,3}}(?:[.,][{DIGITS}]{{3}})++(?:[.,][{DIGITS}]+)?)"
DOUBLED_MARK = f"([{COMBINING}])\\1+"
BLANK_BEFORE_MARK = f"[ \\t]+([{COMBINING}])"
#: A vowel below behind a tone, or the mark below (U+0EBA) behind such a vowel.
MISPLACED_MARK = "[\\x{EB8}-\\x{EBA}](?:(?<=[\\x{EC8}-\\x{ECB}].)|(?<=[\\x{EB8}\\x{EB9}]\\x{EBA}))"
UNICODE_BLANKS = "(?U)\\s+"
#: Blanks that aren't a single plain one.
UNEVEN_BLANKS = "(?U) \\s+|[^\\S ]\\s*"
#: Characters whose upper case is longer than one, and their single upper case; those that have none stay.
GROWING = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
GROWING_UPPER = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in GROWING)


@F.arrow_udf(T.StringType())
def composed(found: pa.Array) -> pa.Array:
    return batches.mapped(found, lambda t: unicodedata.normalize("NFC", t), pa.string())


def nfc(text: Column) -> Column:
    """Texts without a character from U+0300 on, those of the script aside, are in this form already, and stay out of Python. So are characters of the script but for marks in another than their canonical order."""
    return F.coalesce(composed(F.when(text.rlike(f"[^\\x{{0}}-\\x{{2FF}}{LAO}]"), text).when(text.rlike(MISPLACED_MARK), text)), text)


def upper_by_character(text: Column) -> Column:
    """Upper case in which a character stays one: `upper` makes two or three of 102 characters, such as the sharp s."""
    runs = F.regexp_extract_all(text, F.lit(f"[{GROWING}]|[^{GROWING}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{GROWING}]"), F.translate(r, GROWING, GROWING_UPPER)).otherwise(F.upper(r))), "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"[{ZERO_WIDTH_IN_NORMAL}]", ""), UNEVEN_BLANKS, " "))


def normalised(text: Column) -> Column:
    """NFC, without zero-width characters, blanks squeezed and trimmed."""
    return squeezed(nfc(text))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def defect_counts(text: Column) -> Column:
    """zero_width, doubled_marks, blank_before_mark and their total."""
    parts = {"zero_width": f"[{ZERO_WIDTH_IN_DEFECTS}]", "doubled_marks": DOUBLED_MARK, "blank_before_mark": BLANK_BEFORE_MARK}
    counts = {k: count_of(text, p) for k, p in parts.items()}
    return F.struct(*[c.alias(k) for k, c in counts.items()], sum(counts.values(), F.lit(0)).cast("long").alias("total"))


def defect_samples(text: Column) -> Column:
    """Up to three stretches around defects: two of doubled marks, then one of a blank before a mark."""
    around = lambda p: F.regexp_extract_all(text, F.lit(f"(?s).{{0,12}}{p}.{{0,12}}"), F.lit(0))
    return F.slice(F.concat(F.slice(around(DOUBLED_MARK), 1, 2), F.slice(around(BLANK_BEFORE_MARK), 1, 1)), 1, 3)


def defects_fixed(text: Column, passes: int = 1) -> Column:
    """One pass by default. A pass can bring a doubled mark about anew (mark, blank, mark); two passes reach the fixpoint."""
    fixed = text
    for _ in range(passes):
        fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(fixed, f"[{ZERO_WIDTH_IN_DEFECTS}]", ""), DOUBLED_MARK, "$1"), BLANK_BEFORE_MARK, "$1")
    return F.when(text.rlike(f"[{ZERO_WIDTH_IN_DEFECTS}{COMBINING}]"), fixed).otherwise(text)  # each defect has one of these characters


def language(text: Column) -> Column:
    """lo, en or mixed by a census of Lao characters and ASCII letters and digits."""
    lao, latin = count_of(text, f"[{LAO}]"), count_of(text, "[A-Za-z0-9]")
    share = lao / F.greatest(lao + latin, F.lit(1))
    return F.when(lao == 0, "en").when(latin == 0, "lo").when(share >= 0.9, "lo").when(share <= 0.1, "en").otherwise("mixed")


def amounts(text: Column) -> Column:
    """The different amount literals in order of their first place, as written."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda c: F.trim(c)))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, LAO_DIGITS, "0123456789")


def account_attributes(code: Column) -> Column:
    """Class, normal balance and statement by a code's first digit."""
    lead = F.substring(ascii_digits(F.trim(code)), 1, 1)
    by_lead = {"2": ("liability", "credit", "BS"), "3": ("equity", "credit", "BS"), "4": ("revenue", "credit", "PL"), "5": ("expense", "debit", "PL"), "6": ("expense", "debit", "PL")}
    pick = lambda k, other: F.coalesce(*[F.when(lead == d, F.lit(v[k])) for d, v in by_lead.items()], F.lit(other))
    return F.struct(pick(0, "asset").alias("account_class"), pick(1, "debit").alias("normal_balance"), pick(2, "BS").alias("statement"))


def sentences(text: Column) -> Column:
    """Stretches up to and with an end character, trimmed, without empty ones."""
    found = F.regexp_extract_all(text, F.lit(f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+$"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, UNICODE_BLANKS), lambda t: t != "")


def lexemes(text: Column) -> Column:
    """Lower-cased tokens. What a letter's lower case is depends on letters up to the next blank alone, so the text's does for its tokens."""
    return tokens(F.lower(text))


def once_exploded(rows: DataFrame, pos: str, item: str, items: Column, *kept: Column | str) -> DataFrame:
    """The kept columns beside each of a row's items and its place; rows without items end here. An inner explode lets the optimizer ask beforehand, and below joins, whether
    there are items, which makes each row's list two times more; an outer one makes it once, and drops what is empty behind it."""
    return rows.select(*kept, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def made_once(rows: DataFrame, name: str, value: Column, *kept: Column | str) -> DataFrame:
    """The kept columns beside a value that several others read. In a plain column that comes out of Python, the optimizer would put its making into each place that reads it; a generator stays where it is."""
    return rows.select(*kept, F.explode_outer(F.array(value)).alias(name))


def segmented(text: Column) -> Column:
    """tokens, joined (by blanks), count and lang of a text; blank-parted, as no word list of the script is there."""
    found = tokens(text)
    return F.struct(found.alias("tokens"), F.array_join(found, " ").alias("joined"), F.size(found).cast("long").alias("count"), language(text).alias("lang"))


def tags_stripped(html: Column) -> Column:
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "&#x?\\d+;", " "), "\\s+", " "), "^ | $", "")


def page_text(html: Column, most_chars: int | None = 4000, most_bytes: int | None = 500_000) -> Column:
    """Readable text of a page: without scripts, styles and page furniture, capped as a reader's excerpt is; with None, whole."""
    body = html if most_bytes is None else F.substring(html, 1, most_bytes)
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        body = F.regexp_replace(body, f"(?is)<{tag}.*?</{tag}>", " ")
    return tags_stripped(body) if most_chars is None else F.substring(tags_stripped(body), 1, most_chars)


def title_of(question: Column, most: int = 48, default: str = "New conversation") -> Column:
    first = F.trim(F.split_part(F.trim(question), F.lit("\n"), F.lit(1)))
    return F.when(F.coalesce(F.length(first), F.lit(0)) == 0, F.lit(default)).when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("…"))).otherwise(first)


def account_codes_in(question: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(question, F.lit("\\b\\d{4,6}\\b"), F.lit(0))), 1, 3)


def core_name(name: Column) -> Column:
    """The first word of a customer's name without legal forms."""
    return F.split_part(F.regexp_replace(F.trim(F.regexp_replace(name, LEGAL_FORMS, "")), "\\s+", " "), F.lit(" "), F.lit(1))


def list_cell(cell: Column, mark: str = "|") -> Column:
    return F.filter(F.transform(F.split(cell, f"\\{mark}"), lambda c: F.trim(c)), lambda x: x != "")


def pipe_row(line: Column) -> Column:
    """Cells of a pipe-bounded row; an escaped pipe stays in its cell."""
    bare = F.regexp_replace(F.trim(line), "^\\||(?<!\\\\)\\|$", "")
    return F.transform(F.split(bare, "(?<!\\\\)\\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def table_markdown(cells: Column) -> Column:
    """Rows of cells as a pipe table, ragged rows padded and pipes escaped."""
    width = F.array_max(F.transform(cells, F.size))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    rows = F.transform(cells, row)
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, 2147483646)), "\n")


def excerpt(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)
