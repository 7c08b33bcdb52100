"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafmill.functions import measures
from sheafmill.operators import ledger as ops
from sheafmill.plans import adapters as A

QUERIES = {
    "receivables_by_customer": lambda s, d: ops.receivables(A.invoices(s, d)),
    "receivables_named": lambda s, d: ops.receivables(A.invoices(s, d), "customer#0000001"),
    "invoice_lookup": lambda s, d: ops.invoice_lookup(A.invoices(s, d), "inv-1"),
    "account_balance": lambda s, d: ops.account_balance(A.ledger(s, d), "4"),
    "trial_balance": lambda s, d: ops.trial_balance(A.ledger(s, d)),
    "trial_balance_tieout": lambda s, d: ops.tie_out(A.ledger(s, d)),
    "vat_add": lambda s, d: A.table(s, d, "orders").select("o_orderkey", A.cents(F.col("o_totalprice")).alias("net"), measures.vat_on(A.cents(F.col("o_totalprice")), 1000).alias("vat")).withColumn("gross", F.col("net") + F.col("vat")),
    "vat_extract": lambda s, d: A.table(s, d, "orders").select("o_orderkey", A.cents(F.col("o_totalprice")).alias("gross"), measures.net_in(A.cents(F.col("o_totalprice")), 1000).alias("net")).withColumn("vat", F.col("gross") - F.col("net")),
    "paid_by_invoice": lambda s, d: ops.paid_by_invoice(
        A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), A.cents(F.col("o_totalprice")).alias("gross")),
        A.table(s, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("invoice_id"), A.cents(F.col("l_extendedprice")).alias("amount"))),
}

ORACLE = {
    "receivables_by_customer": f"WITH {A.INVOICES_SQL} SELECT customer, sum(gross)::BIGINT AS invoiced, sum(paid)::BIGINT AS paid, (sum(gross) - sum(paid))::BIGINT AS outstanding FROM invoices GROUP BY customer",
    "receivables_named": f"WITH {A.INVOICES_SQL} SELECT customer, sum(gross)::BIGINT AS invoiced, sum(paid)::BIGINT AS paid, (sum(gross) - sum(paid))::BIGINT AS outstanding FROM invoices WHERE customer ILIKE '%customer#0000001%' GROUP BY customer",
    "invoice_lookup": f"WITH {A.INVOICES_SQL} SELECT ref, customer, issue_date, status, gross, paid FROM invoices WHERE ref ILIKE '%inv-1%' OR customer ILIKE '%inv-1%' ORDER BY issue_date DESC, ref LIMIT 10",
    "account_balance": f"WITH {A.LEDGER_SQL} SELECT account_code, sum(debit)::BIGINT AS debit, sum(credit)::BIGINT AS credit, (sum(debit) - sum(credit))::BIGINT AS balance FROM ledger WHERE account_code LIKE '4%' GROUP BY account_code",
    "trial_balance": f"WITH {A.LEDGER_SQL} SELECT account_code, sum(debit)::BIGINT AS debit, sum(credit)::BIGINT AS credit FROM ledger GROUP BY account_code",
    "trial_balance_tieout": f"WITH {A.LEDGER_SQL} SELECT sum(debit)::BIGINT AS debit, sum(credit)::BIGINT AS credit, sum(debit) = sum(credit) AS ties FROM ledger",
    "vat_add": "WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS net FROM orders) SELECT o_orderkey, net, (net * 1000 + 5000) // 10000 AS vat, net + (net * 1000 + 5000) // 10000 AS gross FROM o",
    "vat_extract": "WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS gross FROM orders) SELECT o_orderkey, gross, (gross * 10000 + 5500) // 11000 AS net, gross - (gross * 10000 + 5500) // 11000 AS vat FROM o",
    "paid_by_invoice": "SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS gross, coalesce((SELECT sum(round(l_extendedprice * 100)::BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F'), 0)::BIGINT AS paid FROM orders",
}
