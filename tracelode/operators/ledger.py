"""Business rules over orders, refunds, sessions and invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def refund_eligibility(requests: DataFrame, orders: DataFrame, today: str, days: int = 30) -> DataFrame:
    """First reason against a refund (unknown order, undelivered, too old), else the order's total."""
    age = F.datediff(F.lit(today).cast("date"), F.col("delivered_on").cast("date"))
    reason = F.when(F.col("total").isNull(), "unknown_order").when(F.col("delivered_on").isNull(), "not_delivered").when(age > days, "too_old").otherwise("eligible")
    return requests.join(orders, "order_id", "left").select("request_id", reason.alias("reason"), F.when(reason == "eligible", F.col("total")).alias("amount"))


def refund_gate(refunds: DataFrame, totals: DataFrame, ceiling: float = 500.0, tolerance: float = 0.01) -> DataFrame:
    """(order_id, seq, amount, approved): refunds of an order in sequence, approved while their sum stays at most
    ``ceiling`` and the order's total.

    A blocked refund does not count towards the sum, so this is a fold over the ordered refunds of one order, which are few.
    """
    ordered = refunds.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("seq", "amount"))).alias("r")).join(totals, "order_id")
    fold = f"""aggregate(r, named_struct('sum', 0.0D, 'out', CAST(array() AS ARRAY<STRUCT<seq: BIGINT, amount: DOUBLE, approved: BOOLEAN>>)),
        (acc, x) -> IF(acc.sum + x.amount <= least({ceiling}D, total + {tolerance}D),
            named_struct('sum', acc.sum + x.amount, 'out', concat(acc.out, array(named_struct('seq', CAST(x.seq AS BIGINT), 'amount', x.amount, 'approved', true)))),
            named_struct('sum', acc.sum, 'out', concat(acc.out, array(named_struct('seq', CAST(x.seq AS BIGINT), 'amount', x.amount, 'approved', false))))), acc -> acc.out)"""
    return ordered.select("order_id", F.explode(F.expr(fold)).alias("o")).select("order_id", "o.*")


def identity_gate(actions: DataFrame) -> DataFrame:
    """Is a gated action preceded by a successful verification in its session?"""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce(F.max(F.when((F.col("action") == "verify") & F.col("success"), 1).otherwise(0)).over(before), F.lit(0)) == 1
    judged = actions.withColumn("allowed", ~F.col("gated") | ok)
    return judged.select("session_id", "seq", "action", "allowed")


def case_facts(cases: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row of customer and order facts for each case; unknown ones stay null."""
    return cases.join(customers, "customer_id", "left").join(orders, "order_id", "left")


def coverage_gaps(concerns: DataFrame, findings: DataFrame) -> DataFrame:
    """Concerns without any finding."""
    return concerns.join(findings.select("case_id", "concern").distinct(), ["case_id", "concern"], "left_anti")


def invoice_reconcile(invoices: DataFrame, lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Stated total against the sum of lines; an invoice without lines sums to 0."""
    sums = lines.groupBy("invoice_id").agg(F.sum("amount").alias("line_sum"), F.count("*").alias("n_lines"))
    j = invoices.join(sums, "invoice_id", "left").fillna(0, ["line_sum", "n_lines"])
    gap = F.round(F.col("stated") - F.col("line_sum"), 4)
    return j.select("invoice_id", F.round("line_sum", 4).alias("line_sum"), "n_lines", gap.alias("gap"), (F.abs(gap) > tolerance).alias("mismatch"))
