"""Catalogue: registry, configuration resolution, requests and streaming (SURVEY §7.3
group "registry" and R1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import features as fe
from ledgerlens.operators import scoring
from ledgerlens.operators.selection import best_minimal
from ledgerlens.plans.catalog import ORACLES, query
from ledgerlens.plans.q_knn import KEYS, ORDER_BASE, ORDER_SPEC, order_model, vote_sql
from ledgerlens.plans.q_select import FULL, _cv, cv_sql
from ledgerlens.session import materialize, scratch_path
from ledgerlens.sources import registry as reg
from ledgerlens.sources import requests as rq
from ledgerlens.sources import standins as si
from ledgerlens.sources.tables import read_table
from ledgerlens.streaming.score_stream import score_stream


@query("latest_version", """
WITH runs AS (SELECT CAST(user_id AS VARCHAR) AS tenant_id, strftime(ts, '%Y-%m-%d-%H-%M-%S') AS run_ts FROM events)
SELECT tenant_id, run_ts, strptime(run_ts, '%Y-%m-%d-%H-%M-%S') AS run_time FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY strptime(run_ts, '%Y-%m-%d-%H-%M-%S') DESC, run_ts DESC) AS r
  FROM runs) WHERE r = 1""")
def latest_version(spark, d):
    """Latest run per tenant; run stamps are the events' times as 'yyyy-MM-dd-HH-mm-ss'."""
    runs = read_table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("tenant_id"),
        F.date_format("ts", reg.RUN_TS_FORMAT).alias("run_ts"))
    return reg.latest_version(runs).select("tenant_id", "run_ts", "run_time")


DEFAULTS = [reg.DefaultConfig("accrec_accpay", ("c_mktsegment", "o_orderstatus", "o_totalprice")),
            reg.DefaultConfig("expclaim", ("status", "total"))]


@query("resolve_config", cv_sql(FULL) + """,
cvn AS (SELECT cv.*, cset.n_features FROM cv JOIN cset USING (cand)),
sel AS (SELECT tenant_id, table_name, string_split(cand, ',') AS features, k, weights FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name ORDER BY mean_accuracy DESC, n_features, k, weights, cand) AS r
  FROM cvn) WHERE r = 1),
dft(table_name, default_features, default_k, default_weights) AS (VALUES
  ('accrec_accpay', ['c_mktsegment', 'o_orderstatus', 'o_totalprice'], 7, 'distance'),
  ('expclaim', ['status', 'total'], 7, 'distance')),
grp AS (SELECT DISTINCT tenant_id, table_name FROM s
        UNION SELECT DISTINCT CAST(c_nationkey AS VARCHAR), 'expclaim' FROM customer)
SELECT g.tenant_id, g.table_name, coalesce(sel.features, dft.default_features) AS features,
       coalesce(CAST(sel.k AS INTEGER), dft.default_k) AS k, coalesce(sel.weights, dft.default_weights) AS weights,
       CASE WHEN sel.features IS NOT NULL THEN 'selection' ELSE 'default' END AS source
FROM grp g LEFT JOIN dft USING (table_name) LEFT JOIN sel ON sel.tenant_id = g.tenant_id AND sel.table_name = g.table_name""")
def resolve_config(spark, d):
    """Selected config where a selection run exists (orders), table defaults elsewhere (claims)."""
    cv = _cv(spark, d, FULL)
    best = reg.rank_one(cv).select(*KEYS, F.split("cand", ",").alias("features"), "k", "weights")
    claims = si.expense_claims(spark, d).select("tenant_id", F.lit("expclaim").alias("table_name"))
    groups = cv.select(*KEYS).unionByName(claims)
    return reg.resolve_config(groups, reg.defaults_frame(spark, DEFAULTS), best)


@query("selection_report", cv_sql(FULL) + """,
cvn AS (SELECT cv.*, cset.n_features FROM cv JOIN cset USING (cand))
SELECT tenant_id, table_name, rank, printf('%d. features=[%s] k=%d weights=%s mean_accuracy=%.4f folds=%d',
       rank, cand, k, weights, mean_accuracy, n_folds) AS line FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, table_name ORDER BY mean_accuracy DESC, n_features, k, weights, cand) AS INTEGER) AS rank
  FROM cvn)""")
def selection_report(spark, d):
    """Ranked text report of the CV results per group."""
    return reg.report_lines(_cv(spark, d, FULL))


def _saved_selection(spark, d) -> str:
    """Folder of two selection runs of the orders; the earlier one ranks the configs the other way round."""
    cv = materialize(_cv(spark, d, FULL), "selection_cv")
    base = scratch_path(spark, "selection")
    for run_ts, rows in (("2024-01-31-23-59-59", cv.withColumn("mean_accuracy", 1 - F.col("mean_accuracy"))), ("2024-02-01-00-00-00", cv)):
        reg.save_selection(rows, best_minimal(rows, KEYS), base, run_ts)
    return base


@query("selection_artefacts", ORACLES["selection_report"].replace("AS line FROM (", "AS line, '2024-02-01-00-00-00' AS run_ts FROM ("))
def selection_artefacts(spark, d):
    """The ranked report of the latest of two saved selection runs."""
    return reg.load_selection(spark, _saved_selection(spark, d))["selection_report"]


@query("resolve_config_saved", ORACLES["resolve_config"])
def resolve_config_saved(spark, d):
    """Configs from the latest saved selection run where a tenant has one, table defaults elsewhere."""
    claims = si.expense_claims(spark, d).select("tenant_id", F.lit("expclaim").alias("table_name"))
    groups = si.order_features(spark, d).select(*KEYS).unionByName(claims)
    return reg.saved_config(spark, _saved_selection(spark, d), groups, reg.defaults_frame(spark, DEFAULTS))


@query("registry_latest_stats", ORDER_BASE + """
SELECT tenant_id, table_name, 'o_totalprice' AS feature, round(m, 6) AS mean, round(s, 6) AS std,
       '2024-02-01-00-00-00' AS run_ts FROM st""")
def registry_latest_stats(spark, d):
    """S11 + S17: write model stats for two runs, read back the latest run per tenant."""
    model, _ = order_model(spark, d)
    path = scratch_path(spark, "model_numeric_stats")
    st = fe.numeric_stats(model.ref, KEYS, ORDER_SPEC.numeric)
    older = st.withColumn("mean", F.col("mean") + F.lit(1.0))     # an earlier, different run
    reg.write_partitioned(older, path, "2024-01-31-23-59-59")
    reg.write_partitioned(st, path, "2024-02-01-00-00-00")
    latest = reg.read_latest(spark, path)
    return latest.select(*KEYS, "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                         F.col("run_ts").cast("string").alias("run_ts"))


@query("score_stream", ORDER_BASE + f" SELECT * FROM {vote_sql('nb', 'distance')}")
def score_stream_q(spark, d):
    """The held-out lines arrive as a file stream; every micro-batch is scored with the model."""
    model, queries = order_model(spark, d)
    src, sink, ckpt = scratch_path(spark, "stream_in"), scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt")
    schema = queries.schema
    # two arrivals (older and newer orders) appended to one directory the stream watches
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    queries.filter(early).write.mode("append").parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    queries.filter(~early).write.mode("append").parquet(src)
    score_stream(spark, model, src, schema, sink, ckpt, max_files=files).awaitTermination()  # the first arrival is a micro-batch
    return spark.read.parquet(sink).drop("batch_id")


@query("request_records", ORDER_BASE + """
SELECT tenant_id, table_name, o_orderkey, o_orderstatus, c_mktsegment, o_totalprice FROM base WHERE is_q""")
def request_records(spark, d):
    """Held-out lines sent as JSON requests (one per tenant), read back with a
    declared schema, cleaned, and routed to tenants that have a model."""
    model, queries = order_model(spark, d)
    path = scratch_path(spark, "requests")
    # one request per tenant and block of 100 consecutive ids: requests stay small
    block = F.floor(F.col("o_orderkey") / 100).cast("long")
    req = (queries.groupBy("tenant_id", "table_name", block.alias("_blk"))
                  .agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                                               "o_orderstatus", "c_mktsegment",
                                               F.col("o_totalprice").cast("string").alias("o_totalprice")))
                       .alias("data"))
                  .select(F.concat_ws("-", F.lit("req"), "tenant_id", "_blk").alias("request_id"), "tenant_id",
                          F.col("table_name").alias("table"), "data"))
    req.write.json(path)
    recs = rq.read_requests(spark, path, "o_orderkey string, o_orderstatus string, c_mktsegment string, "
                                         "o_totalprice string")
    recs = rq.clean_request_records(recs, categorical=("o_orderstatus", "c_mktsegment"),
                                    numeric=("o_totalprice",))
    accepted, _ = rq.route_known(recs, model.stats)
    return accepted.select("tenant_id", "table_name", F.col("o_orderkey").cast("long").alias("o_orderkey"),
                           "o_orderstatus", "c_mktsegment", "o_totalprice")
