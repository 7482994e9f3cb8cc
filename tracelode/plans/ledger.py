"""Queries of business rules, bound to ``orders``, ``lineitem``, ``customer`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import ledger as L
from .registry import Tables, query, source

source("refund_requests", "SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN l_orderkey % 13 = 0 THEN l_orderkey + 100000000 ELSE l_orderkey END AS order_id FROM {lineitem} WHERE l_returnflag = 'R'")
source("order_facts", "SELECT o_orderkey AS order_id, o_totalprice AS total, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS delivered_on FROM {orders}")


@query("""
    SELECT request_id, reason, CASE WHEN reason = 'eligible' THEN total END AS amount FROM (SELECT request_id, total, CASE WHEN total IS NULL THEN 'unknown_order' WHEN delivered_on IS NULL THEN 'not_delivered' WHEN date_diff('day', delivered_on, DATE '1999-06-01') > 30 THEN 'too_old' ELSE 'eligible' END AS reason
        FROM {refund_requests} r LEFT JOIN {order_facts} o ON o.order_id = r.order_id)""")
def refund_eligibility(t: Tables) -> DataFrame:
    return L.refund_eligibility(t("refund_requests"), t("order_facts"), "1999-06-01")


source("refunds", "SELECT l_orderkey AS order_id, l_linenumber * 1000000 + l_partkey AS seq, l_extendedprice / 256 AS amount FROM {lineitem} WHERE l_returnflag = 'R'")
source("order_totals", "SELECT o_orderkey AS order_id, o_totalprice / 1024 AS total FROM {orders}")


@query("""
    WITH RECURSIVE r AS (SELECT f.order_id, seq, amount, total, row_number() OVER (PARTITION BY f.order_id ORDER BY seq, amount) AS k FROM {refunds} f JOIN {order_totals} o ON o.order_id = f.order_id),
    g AS (SELECT order_id, seq, amount, k, amount <= least(500.0, total + 0.01) AS approved, CASE WHEN amount <= least(500.0, total + 0.01) THEN amount ELSE 0 END AS s FROM r WHERE k = 1
        UNION ALL SELECT r.order_id, r.seq, r.amount, r.k, g.s + r.amount <= least(500.0, r.total + 0.01), CASE WHEN g.s + r.amount <= least(500.0, r.total + 0.01) THEN g.s + r.amount ELSE g.s END FROM g JOIN r ON r.order_id = g.order_id AND r.k = g.k + 1)
    SELECT order_id, seq, amount, approved FROM g""")
def refund_gate(t: Tables) -> DataFrame:
    return L.refund_gate(t("refunds"), t("order_totals"))


source("session_actions", "SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'verify' WHEN 'purchase' THEN 'refund' ELSE event_type END AS action, event_type = 'purchase' AS gated, event_id % 9 = 0 AS success FROM {events}")


@query("""
    SELECT session_id, seq, action, NOT gated OR coalesce(max(CASE WHEN action = 'verify' AND success THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS allowed FROM {session_actions}""")
def identity_gate(t: Tables) -> DataFrame:
    return L.identity_gate(t("session_actions"))


source("support_cases", "SELECT o_orderkey AS case_id, o_custkey AS customer_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS order_id FROM {orders}")
source("customer_facts", "SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment FROM {customer} WHERE c_custkey % 7 <> 0")


@query("""
    SELECT c.case_id, c.customer_id, c.order_id, name, segment, total, CAST(delivered_on AS STRING) AS delivered_on FROM {support_cases} c LEFT JOIN {customer_facts} f ON f.customer_id = c.customer_id LEFT JOIN {order_facts} o ON o.order_id = c.order_id""")
def case_facts(t: Tables) -> DataFrame:
    facts = L.case_facts(t("support_cases"), t("customer_facts"), t("order_facts"))
    return facts.withColumn("delivered_on", facts["delivered_on"].cast("string"))


source("concerns", "SELECT o_orderkey AS case_id, c.concern FROM {orders} CROSS JOIN (VALUES ('late'), ('damaged'), ('price')) AS c(concern)")
source("findings", "SELECT l_orderkey AS case_id, CASE l_returnflag WHEN 'R' THEN 'damaged' WHEN 'A' THEN 'late' ELSE 'price' END AS concern FROM {lineitem}")


@query("SELECT case_id, concern FROM {concerns} EXCEPT SELECT case_id, concern FROM {findings}")
def coverage_gaps(t: Tables) -> DataFrame:
    return L.coverage_gaps(t("concerns"), t("findings"))


source("invoices", "SELECT o_orderkey AS invoice_id, o_totalprice AS stated FROM {orders}")
source("invoice_lines", "SELECT l_orderkey AS invoice_id, l_extendedprice * (1 - l_discount) AS amount FROM {lineitem}")


@query("""
    SELECT invoice_id, round(coalesce(s, 0), 4) AS line_sum, coalesce(n, 0) AS n_lines, round(stated - coalesce(s, 0), 4) AS gap, abs(round(stated - coalesce(s, 0), 4)) > 0.01 AS mismatch
    FROM {invoices} LEFT JOIN (SELECT invoice_id AS i, sum(amount) AS s, count(*) AS n FROM {invoice_lines} GROUP BY invoice_id) ON i = invoice_id""")
def invoice_reconcile(t: Tables) -> DataFrame:
    return L.invoice_reconcile(t("invoices"), t("invoice_lines"))
