"""Scores, hashes and integer money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_CONSTANT = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if the lengths differ or a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1.0 - dot(a, b) / norms)


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def vector_parsed(s: Column) -> Column:
    return F.from_json(s, "array<float>")


def rrf(rank: Column, constant: int = RRF_CONSTANT) -> Column:
    """1 / (constant + rank), 0 where there is no rank."""
    return F.coalesce(F.lit(1.0).cast("double") / (F.lit(constant) + rank), F.lit(0.0))


def half_up(numerator: Column, denominator: int) -> Column:
    """numerator / denominator, rounded half up, in integers of 38 digits, for numerators from 0."""
    raised = numerator.cast("decimal(38,0)") + denominator // 2
    return (raised - raised % denominator) / denominator


def vat_on(net: Column, basis_points: int) -> Column:
    """VAT of a net amount."""
    return half_up(net.cast("decimal(38,0)") * basis_points, 10_000).cast("long")


def net_in(gross: Column, basis_points: int) -> Column:
    """Net part of an amount that holds VAT."""
    return half_up(gross.cast("decimal(38,0)") * 10_000, 10_000 + basis_points).cast("long")


def fnv1a_unit(s: Column) -> Column:
    """FNV-1a of a string of ASCII characters, folded to hundred-thousandths of 0 to 1."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return (folded % 100_000) / F.lit(100_000.0)


def split_name(unit: Column, train: float = 0.7, dev: float = 0.15) -> Column:
    return F.when(unit < train, "train").when(unit < train + dev, "dev").otherwise("test")


def nearest_rank(ordered: Column, percent: int) -> Column:
    """The element at min(n - 1, floor(percent / 100 * n)) of a sorted array; 0 of an empty one."""
    n = F.size(ordered)
    at = F.least(n - 1, F.floor(n * percent / F.lit(100.0)).cast("int"))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.get(ordered, at))


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of gold entries (repeats count) among the first k; 0 without gold."""
    hits = F.size(F.filter(gold, lambda g: F.array_contains(F.slice(retrieved, 1, k), g)))
    return F.when(F.size(gold) == 0, F.lit(0.0)).otherwise(hits / F.size(gold))


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    """1 over the place of the first retrieved entry that is gold; 0 without one."""
    marks = F.transform(retrieved, lambda r: F.array_contains(gold, r))
    place = F.array_position(marks, True)
    return F.when(place > 0, F.lit(1.0) / place).otherwise(F.lit(0.0))


def backoff_seconds(attempts: Column, base: int = 5) -> Column:
    return (base * F.pow(F.lit(2.0), attempts)).cast("long")


def http_backoff_ms(attempts: Column, key: Column, base: int = 250) -> Column:
    """Doubling from `base`, and up to as much again less one by a hash of the key and the attempt, so that a rerun waits alike."""
    return (base * F.pow(F.lit(2.0), attempts)).cast("long") + F.pmod(F.xxhash64(key, attempts), F.lit(base))


def clamp(x: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(default))))
