"""Ledger reports over invoices (customer, gross, paid, ...) and entries (account_code, debit, credit), in integer money."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def receivables(invoices: DataFrame, name: str | None = None) -> DataFrame:
    """Invoiced, paid and outstanding by customer; `name` is a case-insensitive pattern part."""
    rows = invoices if name is None else invoices.where(F.col("customer").ilike(f"%{name}%"))
    return rows.groupBy("customer").agg(F.sum("gross").alias("invoiced"), F.sum("paid").alias("paid"), (F.sum("gross") - F.sum("paid")).alias("outstanding"))


def invoice_lookup(invoices: DataFrame, needle: str, most: int = 10) -> DataFrame:
    """The newest invoices whose ref or customer holds the needle."""
    found = invoices.where(F.col("ref").ilike(f"%{needle}%") | F.col("customer").ilike(f"%{needle}%"))
    return found.select("ref", "customer", "issue_date", "status", "gross", "paid").orderBy(F.desc("issue_date"), "ref").limit(most)


def account_balance(entries: DataFrame, prefix: str = "") -> DataFrame:
    rows = entries.where(F.col("account_code").startswith(prefix))
    return rows.groupBy("account_code").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), (F.sum("debit") - F.sum("credit")).alias("balance"))


def trial_balance(entries: DataFrame) -> DataFrame:
    return entries.groupBy("account_code").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))


def tie_out(entries: DataFrame) -> DataFrame:
    """Both sides' totals and whether they are equal."""
    return entries.agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit")).withColumn("ties", F.col("debit") == F.col("credit"))


def paid_by_invoice(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoices with the sum of their payments, 0 without one."""
    paid = payments.groupBy("invoice_id").agg(F.sum("amount").alias("paid"))
    return invoices.join(paid, invoices["id"] == paid["invoice_id"], "left").select(invoices["*"], F.coalesce("paid", F.lit(0)).alias("paid"))
