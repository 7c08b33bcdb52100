"""Golden values of a small ledger, worked out by hand."""

from pyspark.sql import functions as F

from sheafmill.functions import measures
from sheafmill.operators import ledger

INVOICES = [("c1", 14_300_000, 6_000_000), ("c2", 5_500_000, 5_500_000), ("c3", 11_000_000, 11_000_000), ("c3", 11_000_000, 0)]
ENTRIES = [("411", 41_800_000, 22_500_000), ("4331", 0, 3_800_000), ("531", 22_500_000, 0), ("701", 0, 38_000_000)]


def test_receivables(spark):
    rows = spark.createDataFrame(INVOICES, "customer string, gross long, paid long")
    found = {r.customer: (r.invoiced, r.paid, r.outstanding) for r in ledger.receivables(rows).collect()}
    assert found == {"c1": (14_300_000, 6_000_000, 8_300_000), "c2": (5_500_000, 5_500_000, 0), "c3": (22_000_000, 11_000_000, 11_000_000)}
    assert {r.customer for r in ledger.receivables(rows, "C1").collect()} == {"c1"}
    assert ledger.receivables(rows, "_1").count() == 1  # patterns aren't escaped


def test_balances(spark):
    rows = spark.createDataFrame(ENTRIES, "account_code string, debit long, credit long")
    assert {r.account_code for r in ledger.account_balance(rows, "4").collect()} == {"411", "4331"}
    assert [r.balance for r in ledger.account_balance(rows, "41").collect()] == [19_300_000]
    total = ledger.tie_out(rows).first()
    assert (total.debit, total.credit, total.ties) == (64_300_000, 64_300_000, True)


def test_payments_default_to_nothing(spark):
    invoices = spark.createDataFrame([(1,), (2,)], "id long")
    payments = spark.createDataFrame([(1, 5), (1, 6)], "invoice_id long, amount long")
    assert {(r.id, r.paid) for r in ledger.paid_by_invoice(invoices, payments).collect()} == {(1, 11), (2, 0)}


def test_vat_rounds_half_up(spark):
    rows = spark.createDataFrame([(0,), (4,), (5,), (14,), (15,), (10**17,)], "n long")
    for r in rows.select("n", measures.vat_on(F.col("n"), 1000).alias("vat"), measures.net_in(F.col("n"), 1000).alias("net")).collect():
        assert r.vat == (r.n * 1000 + 5000) // 10_000 and r.net == (r.n * 10_000 + 5500) // 11_000
    assert spark.range(1).select(measures.net_in(F.lit(11_000_000), 1000).alias("n")).first().n == 10_000_000


def test_percentile_is_the_nearest_rank(spark):
    for n, want in ((0, 0.0), (1, 0.0), (20, 19.0), (60, 57.0)):
        got = spark.range(1).select(measures.nearest_rank(F.array(*[F.lit(float(i)) for i in range(n)]).cast("array<double>"), 95).alias("v")).first().v
        assert got == want


def test_recall_counts_repeats(spark):
    lists = spark.createDataFrame([([1, 2, 3], [2, 2, 9]), ([1], [])], "found array<long>, gold array<long>")
    got = lists.select(measures.recall_at(F.col("found"), F.col("gold"), 2).alias("r"), measures.reciprocal_rank(F.col("found"), F.col("gold")).alias("m")).collect()
    assert [(round(r.r, 6), r.m) for r in got] == [(0.666667, 0.5), (0.0, 0.0)]


def test_unit_hash_is_fnv(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h % 100_000 / 100_000

    words = ["", "a", "0190f3c2-7b1a-7c44-9c1e-3f2b1a0d9e8f", "Brand#12"]
    got = {r.s: r.u for r in spark.createDataFrame([(w,) for w in words], "s string").select("s", measures.fnv1a_unit(F.col("s")).alias("u")).collect()}
    assert got == {w: fnv(w) for w in words}
