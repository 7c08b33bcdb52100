"""Predicates, validators and order-keeping lookups that curated lists are read with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats and closed lists of the data model.
FORMATS = {"code": "^[0-9]{3,6}$", "amount": "^[0-9]+$", "version": "^[0-9]+\\.[0-9]+\\.[0-9]+$", "slug": "^[a-z0-9]+(-[a-z0-9]+)*$", "uuid": "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"}
CHOICES = {
    "review": ("pending", "accepted", "rejected", "edited"), "kind": ("prose", "table", "list", "account_row", "formula", "journal_entry"), "split": ("unassigned", "train", "dev", "test"),
    "license": ("public", "internal", "client-confidential"), "lang": ("lo", "en", "mixed", "th"), "normal_balance": ("debit", "credit"), "statement": ("BS", "PL", "CF", "NONE"), "role": ("user", "assistant"),
}


def of_tenant(rows: DataFrame, hf_id: str, company_id: str) -> DataFrame:
    """Rows of one tenant; with the table partitioned by these columns, only its partitions are read."""
    return rows.where((F.col("hf_id") == hf_id) & (F.col("company_id") == company_id))


def among(rows: DataFrame, column: Column, wanted: Sequence | None) -> DataFrame:
    """Rows whose value is listed; an empty or absent list filters nothing."""
    return rows.where(column.isin(list(wanted))) if wanted else rows


def flagged(rows: DataFrame, column: Column, wanted: bool | None) -> DataFrame:
    """Rows with a flag set, unset, or, for None, all."""
    return rows if wanted is None else rows.where(column == F.lit(wanted))


def matching(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows that hold the needle in any of the columns, letter case aside; % and _ in it are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return rows.where(hit)


def clamped(limit: int, most: int = 50) -> int:
    return max(1, min(limit, most))


def listed(rows: DataFrame, order: list, limit: int, most: int = 50) -> DataFrame:
    return rows.orderBy(*order).limit(clamped(limit, most))


def flag_first(rows: DataFrame, flag: str, *order: str, limit: int = 50) -> DataFrame:
    """A list with the rows first whose flag is set, each part in order."""
    return listed(rows, [F.desc(flag), *order], limit)


def has_format(value: Column, name: str) -> Column:
    return F.coalesce(value.rlike(FORMATS[name]), F.lit(False))


def problems(**checks: Column) -> Column:
    """Names of the checks that a row fails or leaves open."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def within(value: Column, low: int, high: int) -> Column:
    """Whether an optional number is in its bounds; an absent one is."""
    return F.coalesce(value.between(low, high), F.lit(True))


def long_enough(value: Column, least: int = 1) -> Column:
    return F.coalesce(F.length(value) >= least, F.lit(False))


def request_problems(query: Column, k: Column) -> Column:
    """What is wrong with a search request: its query needs a character, its k lies from 1 to 50."""
    return problems(query=long_enough(query), k=within(k, 1, 50))


def is_choice(value: Column, name: str) -> Column:
    return value.isin(*CHOICES[name])


def looked_up(lists: DataFrame, contents: DataFrame, key: str = "query_id", ids: str = "ids") -> DataFrame:
    """(key, contents): each list's contents in its order, an empty string for an unknown id."""
    rows = lists.select(key, F.posexplode(ids).alias("place", "id")).join(contents.select("id", "content"), "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("place", F.coalesce("content", F.lit("")).alias("c"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x["c"]).alias("contents"))


def with_default_first(values: Column, default: str) -> Column:
    """An array with the default in front if it lacks it."""
    return F.when(F.array_contains(values, default), values).otherwise(F.concat(F.array(F.lit(default)), values))
