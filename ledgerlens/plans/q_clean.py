"""Catalogue: cleaning rules and group profiles (SURVEY §7.3 group "clean")."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import labels, tax
from ledgerlens.operators import profile
from ledgerlens.plans.catalog import query
from ledgerlens.plans.sql_standins import OF, with_
from ledgerlens.sources import standins as si
from ledgerlens.sources.tables import read_table

KEYS = ("tenant_id", "table_name")


def _orders_by_customer(spark, d):
    """Order lines with one tenant per customer: many small groups (skip rules fire)."""
    return si.order_features(spark, d).withColumn("tenant_id", F.col("o_custkey").cast("string"))


_OF_CUST = """ofc AS (SELECT * REPLACE (CAST(o_custkey AS VARCHAR) AS tenant_id) FROM of)"""


@query("clean_target", """
SELECT event_id, CASE WHEN t IS NULL OR t IN ('None', 'nan', 'NaN') THEN 'NOT_APPLICABLE' ELSE t END AS target
FROM (SELECT event_id, nullif(event_type, 'error') AS t FROM events)""")
def clean_target(spark, d):
    ev = read_table(spark, d, "events")
    return ev.select("event_id", labels.clean_target(F.nullif(F.col("event_type"), F.lit("error")))
                     .alias("target"))


_F2 = """CASE WHEN TRY_CAST({s} AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST({s} AS DOUBLE))
  AND abs(TRY_CAST({s} AS DOUBLE)) < 9e18 AND TRY_CAST({s} AS DOUBLE) = floor(TRY_CAST({s} AS DOUBLE))
  THEN CAST(CAST(TRY_CAST({s} AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE {s} END"""


@query("float_string_label", """
SELECT line_item_id, qty_text, tax_text, """ + _F2.format(s="qty_text") + """ AS qty_label,
       """ + _F2.format(s="tax_text") + """ AS tax_label
FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_item_id,
             CAST(l_quantity AS VARCHAR) AS qty_text, CAST(l_tax AS VARCHAR) AS tax_text FROM lineitem)""")
def float_string_label(spark, d):
    l = read_table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_item_id"),
        F.col("l_quantity").cast("string").alias("qty_text"),
        F.col("l_tax").cast("string").alias("tax_text"))
    return l.select("*", labels.float_string_label("qty_text").alias("qty_label"),
                    labels.float_string_label("tax_text").alias("tax_label"))


@query("clean_records", """
SELECT event_id,
       CASE WHEN lower(kind) IN ('nan', 'none') THEN NULL ELSE kind END AS kind,
       CASE WHEN lower(k_text) IN ('nan', 'none') OR TRY_CAST(k_text AS DOUBLE) IS NULL
              OR isnan(TRY_CAST(k_text AS DOUBLE)) THEN NULL ELSE TRY_CAST(k_text AS DOUBLE) END AS k_value,
       CASE WHEN lower(v_text) IN ('nan', 'none') OR TRY_CAST(v_text AS DOUBLE) IS NULL
              OR isnan(TRY_CAST(v_text AS DOUBLE)) THEN NULL ELSE TRY_CAST(v_text AS DOUBLE) END AS v_value
FROM (SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k_text,
             CAST(value AS VARCHAR) AS v_text FROM events)""")
def clean_records(spark, d):
    """F3 over raw request-like text fields of every event."""
    ev = read_table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").alias("k_text"),
        F.col("value").cast("string").alias("v_text"))
    out = labels.clean_records(ev, categorical=("kind",), numeric=("k_text", "v_text"))
    return out.withColumnRenamed("k_text", "k_value").withColumnRenamed("v_text", "v_value")


@query("class_counts", with_(OF) + """
SELECT tenant_id, table_name, o_orderpriority AS class, count(*) AS n FROM of GROUP BY ALL""")
def class_counts(spark, d):
    return profile.class_counts(si.order_features(spark, d), KEYS, "o_orderpriority")


@query("rare_classes", with_(OF, _OF_CUST) + """
SELECT tenant_id, table_name, o_orderpriority AS class, count(*) AS n, count(*) >= 5 AS kept
FROM ofc GROUP BY ALL""")
def rare_classes(spark, d):
    c = profile.class_counts(_orders_by_customer(spark, d), KEYS, "o_orderpriority")
    return profile.rare_classes(c, KEYS)


@query("rare_classes_pct", """
SELECT tenant_id, table_name, class, n, threshold, n >= threshold AS kept FROM (
  SELECT *, CAST(floor(max(n) OVER (PARTITION BY tenant_id, table_name) * 0.01) AS BIGINT) AS threshold
  FROM (SELECT l_linestatus AS tenant_id, 'lines' AS table_name,
               l_returnflag || '-' || CAST(l_suppkey % 7 AS VARCHAR) AS class, count(*) AS n
        FROM lineitem GROUP BY ALL))""")
def rare_classes_pct(spark, d):
    l = read_table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("tenant_id"), F.lit("lines").alias("table_name"),
        F.concat(F.col("l_returnflag"), F.lit("-"), (F.col("l_suppkey") % 7).cast("string")).alias("cls"))
    c = profile.class_counts(l, KEYS, "cls")
    return profile.rare_classes_pct(c, KEYS)


_FEATS = ("o_orderstatus", "c_mktsegment", "o_totalprice", "o_orderpriority")


def _unpivot_sql(src: str, feats, extra: str) -> str:
    parts = [f"""SELECT tenant_id, table_name, '{c}' AS feature, count(DISTINCT {c}) AS n_distinct,
       count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM {src} GROUP BY tenant_id, table_name"""
             for c in feats]
    return f"SELECT *, n_null > 0 AS has_null{extra} FROM (" + "\nUNION ALL\n".join(parts) + ")"


@query("constant_columns", with_(OF, _OF_CUST) + """
SELECT *, n_distinct + CAST(has_null AS BIGINT) AS n_unique,
       n_distinct + CAST(has_null AS BIGINT) = 1 AS is_constant
FROM (""" + _unpivot_sql("ofc", _FEATS, "") + ")")
def constant_columns(spark, d):
    return profile.constant_columns(_orders_by_customer(spark, d), KEYS, _FEATS)


@query("valid_text_features", """
WITH docs AS (SELECT source AS tenant_id, 'documents' AS table_name, text, lang FROM documents)
SELECT *, n_distinct >= 2 AS is_valid FROM (""" + _unpivot_sql("docs", ("text", "lang"), "") + ")")
def valid_text_features(spark, d):
    docs = read_table(spark, d, "documents").select(
        F.col("source").alias("tenant_id"), F.lit("documents").alias("table_name"), "text", "lang")
    return profile.valid_text_features(docs, KEYS, ("text", "lang"))


@query("trainable_groups", with_(OF, _OF_CUST) + """
SELECT *, CASE WHEN reason IS NULL THEN 'FINISHED' ELSE 'SKIPPED' END AS state FROM (
  SELECT tenant_id, table_name, count(*) AS n_rows, count(DISTINCT o_orderpriority) AS n_classes,
         CASE WHEN count(*) = 0 THEN 'empty'
              WHEN count(DISTINCT o_orderpriority) <= 1 THEN 'constant_target'
              WHEN count(*) < 7 THEN 'too_few_rows' END AS reason
  FROM ofc GROUP BY tenant_id, table_name)""")
def trainable_groups(spark, d):
    return profile.trainable_groups(_orders_by_customer(spark, d), KEYS, "o_orderpriority", k=7)


@query("selection_guards", with_(OF, _OF_CUST) + """
SELECT *, CASE WHEN reason IS NULL THEN 'READY' ELSE 'SKIPPED' END AS state FROM (
  SELECT tenant_id, table_name, count(*) AS n_rows, count(DISTINCT o_orderpriority) AS n_classes,
         CASE WHEN count(*) = 0 THEN 'empty'
              WHEN count(DISTINCT o_orderpriority) <= 1 THEN 'constant_target'
              WHEN count(*) < count(DISTINCT o_orderpriority) * 5 THEN 'too_few_rows_per_class'
              WHEN count(*) < 12.5 THEN 'too_few_rows_for_cv'
              WHEN 10000 < count(DISTINCT o_orderpriority) * 5 THEN 'sample_too_small' END AS reason
  FROM ofc GROUP BY tenant_id, table_name)""")
def selection_guards(spark, d):
    return profile.selection_guards(_orders_by_customer(spark, d), KEYS, "o_orderpriority",
                                    folds=5, k_max=9, sample_rows=10000, min_per_class=5)


_TAX_VALUES = """tt(tax_type, tax_name, tax_rate) AS (VALUES
  ('OUTPUT', 'GST on Income', 10.0::DOUBLE), ('INPUT', 'GST on Expenses', 10.0::DOUBLE),
  ('EXEMPTEXPENSES', 'GST Free Expenses', 0.0::DOUBLE), ('EXEMPTOUTPUT', 'GST Free Income', 0.0::DOUBLE),
  ('BASEXCLUDED', 'BAS Excluded', 0.0::DOUBLE), ('GSTONIMPORTS', 'GST on Imports', 0.0::DOUBLE))"""


@query("tax_type_lookup", "WITH " + _TAX_VALUES + """,
x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_item_id,
             round(l_tax * 100, 0) AS rate_pct, l_linestatus = 'O' AS is_input FROM lineitem),
y AS (SELECT *, CASE WHEN rate_pct = 10.0 AND is_input THEN 'INPUT'
                     WHEN rate_pct = 10.0 AND NOT is_input THEN 'OUTPUT'
                     WHEN rate_pct = 0.0 AND is_input THEN 'EXEMPTEXPENSES'
                     WHEN rate_pct = 0.0 AND NOT is_input THEN 'EXEMPTOUTPUT' END AS tax_type FROM x)
SELECT y.*, tt.tax_name, tt2.tax_type AS tax_type_from_name
FROM y LEFT JOIN tt ON y.tax_type = tt.tax_type
LEFT JOIN tt tt2 ON lower(tt.tax_name) = lower(tt2.tax_name)""")
def tax_type_lookup(spark, d):
    """type from (rate, is_input), its name, and the name resolved back to a type."""
    l = read_table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_item_id"),
        F.round(F.col("l_tax") * 100, 0).alias("rate_pct"),
        (F.col("l_linestatus") == "O").alias("is_input"))
    l = l.withColumn("tax_type", tax.type_from_rate("rate_pct", "is_input"))
    l = tax.with_tax_names(l, "tax_type", spark).drop("tax_rate")
    return tax.with_type_from_name(l, "tax_name", spark)
