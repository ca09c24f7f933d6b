"""Catalogue: checks inside the plan (J15, P16, S22) and temporal neighbours on timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as ev
from ledgerlens.operators import selection as sel
from ledgerlens.operators import temporal
from ledgerlens.plans.catalog import query
from ledgerlens.plans.q_knn import KEYS
from ledgerlens.plans.sql_standins import OF, with_
from ledgerlens.session import scratch_path
from ledgerlens.sources import requests as rq
from ledgerlens.sources import standins as si
from ledgerlens.sources.tables import read_table


@query("truth_violations", """
WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS tenant_id, l_orderkey AS id, l_returnflag AS y FROM lineitem)
SELECT tenant_id, id, count(*) AS n_rows, CASE WHEN count(*) = 1 THEN min(y) END AS y_true FROM t GROUP BY ALL""")
def truth_violations(spark, d):
    """Labels of order lines per supplier; an order with several lines of a supplier has no single truth."""
    truth = read_table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("tenant_id"), F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("correct_target_variable"))
    good = ev.one_truth(truth, ["tenant_id"], strict=False).withColumn("n_rows", F.lit(1).cast("long"))
    return good.unionByName(ev.duplicate_truth(truth, ["tenant_id"]).withColumnRenamed("n", "n_rows").withColumn("y_true", F.lit(None).cast("string")))


_MUST = ("c_mktsegment", "o_totalprice", "o_clerk_name", "o_shippriority")


@query("must_have_violations", with_(OF) + """,
x AS (SELECT tenant_id, table_name, count(*) AS n, count(s) AS n_s, min(s) AS a, max(s) AS b FROM (
  SELECT tenant_id, table_name, CASE WHEN tenant_id = '3' THEN NULL WHEN tenant_id = '7' THEN 'X' ELSE c_mktsegment END AS s FROM of) GROUP BY ALL)
SELECT tenant_id, table_name, 'c_mktsegment' AS feature, CASE WHEN n_s = 0 THEN 'no_value' ELSE 'constant' END AS problem FROM x WHERE n_s = 0 OR (n_s = n AND a = b)
UNION ALL SELECT tenant_id, table_name, 'o_clerk_name', 'no_column' FROM x
UNION ALL SELECT tenant_id, table_name, 'o_shippriority', 'not_a_feature' FROM x""")
def must_have_violations(spark, d):
    """Must-have features per nation that are no feature, no column, empty or constant."""
    t = F.col("tenant_id")
    lines = si.order_features(spark, d).withColumn("c_mktsegment", F.when(t == "3", F.lit(None)).when(t == "7", F.lit("X")).otherwise(F.col("c_mktsegment")))
    return sel.must_have_violations(lines, KEYS, _MUST, ("c_mktsegment", "o_totalprice", "o_orderstatus", "o_clerk_name"))


#: What tells a record's table: its own columns.
_KINDS = {"accrec_accpay": ("o_orderkey", "o_totalprice"), "expclaim": ("claim_no",)}


@query("request_checks", """
WITH r AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS tenant_id, c_mktsegment AS seg FROM customer),
n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)
SELECT concat('req-', c_custkey) AS request_id, tenant_id, 'accrec_accpay' AS table_name, CASE WHEN seg = 'BUILDING' THEN 'mixed_kinds' WHEN seg = 'MACHINERY' THEN 'wrong_kind' END AS reason,
       CASE WHEN seg NOT IN ('BUILDING', 'MACHINERY') THEN n END AS n_records
FROM r JOIN n ON o_custkey = c_custkey
UNION ALL SELECT NULL, NULL, NULL, 'malformed', NULL FROM r JOIN n ON o_custkey = c_custkey WHERE seg = 'FURNITURE'""")
def request_checks(spark, d):
    """A request per customer with its orders; some mix tables, some are of another table, some are cut off."""
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    lines = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    order = F.struct(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("o_totalprice"), F.lit(None).cast("string").alias("claim_no"))
    claim = F.struct(F.lit(None).cast("string").alias("o_orderkey"), F.lit(None).cast("string").alias("o_totalprice"), F.col("o_orderkey").cast("string").alias("claim_no"))
    seg = F.col("c_mktsegment")
    data = (F.when(seg == "BUILDING", F.array(order, claim)).when(seg == "MACHINERY", F.array(claim)).otherwise(F.array(order)))
    req = (lines.groupBy("c_custkey", "c_nationkey", "c_mktsegment").agg(F.flatten(F.collect_list(data)).alias("data"))  # orders of one customer
           .select(F.concat(F.lit("req-"), F.col("c_custkey").cast("string")).alias("request_id"), F.col("c_nationkey").cast("string").alias("tenant_id"), F.lit("accrec_accpay").alias("table"), "data", "c_mktsegment"))
    text = F.to_json(F.struct("request_id", "tenant_id", "table", "data"))
    path = scratch_path(spark, "checked_requests")
    cut = req.filter(seg == "FURNITURE").select(F.substring(text, 1, 20).alias("value"))
    req.select(text.alias("value")).unionByName(cut).write.text(path)
    records, refused = rq.read_checked_requests(spark, path, "o_orderkey string, o_totalprice string, claim_no string", _KINDS, strict=False)
    good = records.groupBy("request_id", "tenant_id", "table_name").agg(F.count(F.lit(1)).alias("n_records")).withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(refused.withColumn("n_records", F.lit(None).cast("long")))


@query("temporal_topk_ts", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS tenant_id, 'events' AS table_name, event_id, epoch_us(ts) AS us FROM events),
p AS (SELECT q.tenant_id, q.table_name, q.event_id AS q_id, t.event_id AS t_id,
             abs(CASE WHEN t.us >= q.us THEN (t.us - q.us) // 86400000000 ELSE -((q.us - t.us + 86399999999) // 86400000000) END) AS days
      FROM e q JOIN e t ON q.tenant_id = t.tenant_id AND q.table_name = t.table_name)
SELECT tenant_id, table_name, q_id, rank, t_id, CAST(days AS BIGINT) AS days FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, q_id ORDER BY days, t_id) AS rank FROM p) WHERE rank <= 7""")
def temporal_topk_ts(spark, d):
    """Per event the 7 events of the same user closest in whole days between their times (floored, then made positive)."""
    e = read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("tenant_id"), F.lit("events").alias("table_name"), "event_id", "ts")
    return temporal.temporal_topk_ts(e, e, KEYS, q_id="event_id", t_id="event_id", q_time="ts", t_time="ts", k=7)
