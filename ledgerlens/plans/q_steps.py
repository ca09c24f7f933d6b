"""Catalogue: multi-table collection, raw storage, catalog, validation, training
summary, explanation records, per-table anomaly union (S1, S7-S10, P12, A3, A31, C5, J13, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import knn, lookup, profile, scoring
from ledgerlens.plans.catalog import query
from ledgerlens.plans.q_knn import (CUST_BASE, CUSTOMER_SPEC, KEYS, NB_COLUMNS, ORDER_BASE, ORDER_SPEC, customers,
                                    order_model, order_split, reported, vote_sql)
from ledgerlens.plans.sql_standins import ACC, AD, BANK, BLI, CLAIMS, CLI, CREDIT, EVAL, HOLDOUT, ILI, INV, RECEIPTS, RLI, with_
from ledgerlens.session import scratch_path
from ledgerlens.sources import line_tables as lt
from ledgerlens.sources import requests as rq
from ledgerlens.sources import standins as si
from ledgerlens.sources.registry import read_artefact
from ledgerlens.sources.tables import catalog_columns, read_table

GIVEN_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
                "pages benchmark labels conversations").split()


def all_line_tables(spark, d):
    """Every line table of every tenant in one frame (first lines, with accounts)."""
    h, l, a = si.invoices(spark, d), si.invoice_line_items(spark, d), si.charted_accounts(spark, d)
    inv = lt.build_lines(h, l, a, si.INVOICE_PLAN)
    claims = lt.build_chain(
        si.expense_claims(spark, d), si.expense_claim_receipts(spark, d), si.receipt_line_items(spark, d), a,
        claim_key="id", receipt_fk="expense_claim_unique_id", receipt_key="id", line_fk="receipt_unique_id",
        claim_cols=("expense_claim_id", "status", "total"), receipt_cols=("receipt_id", "date", "status", "total"),
        line_cols=("receipt_unique_id", "line_item_id", "line_amount", "account_code"),
        first_only=True, receipt_id="receipt_unique_id", line_order=("line_item_id",))
    bank = lt.build_lines(si.bank_transactions(spark, d), si.bank_transaction_line_items(spark, d), a, si.BANK_PLAN)
    credit = lt.build_lines(si.credit_notes(spark, d), si.credit_note_line_items(spark, d), a, si.CREDIT_PLAN)
    cols = ["table_name", "tenant_id", "line_item_id", "account_code", "account_name", "line_amount"]
    out = inv.select(*cols, "invoice_id")
    for table, own in ((claims, "receipt_receipt_id"), (bank, "bank_transaction_id"), (credit, "credit_note_id")):
        out = out.unionByName(table.select(*cols, own), allowMissingColumns=True)
    return out


_ALL_LINES_SQL = with_(INV, ILI, ACC, AD, CLAIMS, RECEIPTS, RLI, BANK, BLI, CREDIT, CLI) + """,
a AS (SELECT * EXCLUDE (rn) FROM (
  SELECT 'accrec_accpay' AS table_name, i.tenant_id, l.line_item_id, l.account_code, ad.account_name, l.line_amount,
         l.invoice_id, row_number() OVER (PARTITION BY l.invoice_id ORDER BY l.line_no, l.part_no, l.supp_no) AS rn
  FROM ili l JOIN inv i ON l.invoice_unique_id = i.id
  LEFT JOIN ad ON l.account_code = ad.code AND i.tenant_id = ad.tenant_id) WHERE rn = 1),
b AS (SELECT * EXCLUDE (rn) FROM (
  SELECT 'expclaim' AS table_name, c.tenant_id, l.line_item_id, l.account_code, ad.account_name, l.line_amount,
         r.receipt_id AS receipt_receipt_id,
         row_number() OVER (PARTITION BY l.receipt_unique_id ORDER BY l.line_item_id) AS rn
  FROM rli l JOIN receipts r ON l.receipt_unique_id = r.id JOIN claims c ON r.expense_claim_unique_id = c.id
  LEFT JOIN ad ON l.account_code = ad.code AND c.tenant_id = ad.tenant_id) WHERE rn = 1),
c AS (SELECT * EXCLUDE (rn) FROM (
  SELECT 'cashrec_cashpaid' AS table_name, h.tenant_id, l.line_item_id, l.account_code, ad.account_name, l.line_amount, h.bank_transaction_id,
         row_number() OVER (PARTITION BY h.tenant_id, l.bank_transaction_id ORDER BY l.line_no, l.line_item_id) AS rn
  FROM bli l JOIN bank h ON l.bank_transaction_unique_id = h.id LEFT JOIN ad ON l.account_code = ad.code AND h.tenant_id = ad.tenant_id) WHERE rn = 1),
d AS (SELECT * EXCLUDE (rn) FROM (
  SELECT 'accreccredit_accpaycredit' AS table_name, h.tenant_id, l.line_item_id, l.account_code, ad.account_name, l.line_amount, h.credit_note_id,
         row_number() OVER (PARTITION BY h.tenant_id, l.credit_note_unique_id ORDER BY l.line_no, l.line_item_id) AS rn
  FROM cli l JOIN credit h ON l.credit_note_unique_id = h.id LEFT JOIN ad ON l.account_code = ad.code AND h.tenant_id = ad.tenant_id) WHERE rn = 1),
allt AS (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b UNION ALL BY NAME SELECT * FROM c UNION ALL BY NAME SELECT * FROM d)"""


@query("lines_all_tables", _ALL_LINES_SQL + " SELECT * FROM allt")
def lines_all_tables(spark, d):
    """The four line tables of all tenants, appended by name."""
    return all_line_tables(spark, d)


@query("table_map", _ALL_LINES_SQL + """
SELECT tenant_id, list_sort(list(DISTINCT table_name)) AS tables FROM allt GROUP BY tenant_id""")
def table_map(spark, d):
    """Which line tables have data, per tenant."""
    return profile.table_map(all_line_tables(spark, d))


@query("raw_collection", with_(INV, ILI, ACC, AD, EVAL) + """
SELECT * EXCLUDE (rn) FROM (
  SELECT 'accrec_accpay' AS table_name, i.tenant_id, l.invoice_unique_id, l.line_item_id, l.description, l.quantity,
         l.line_amount, l.tax_amount, l.account_code, l.item_code, i.invoice_id, i.invoice_number, i.contact_name,
         i.total, ad.account_name, ad.account_type, i.type AS source_type, i.date AS journal_date,
         row_number() OVER (PARTITION BY l.invoice_id ORDER BY l.line_no, l.part_no, l.supp_no) AS rn
  FROM ili l JOIN inv i ON l.invoice_unique_id = i.id
  LEFT JOIN ad ON l.account_code = ad.code AND i.tenant_id = ad.tenant_id) f
WHERE rn = 1 AND tenant_id = '7' AND invoice_id NOT IN (SELECT source_id FROM ev)""")
def raw_collection(spark, d):
    """Collect lines, drop the hold-out, write by (table, tenant), read one tenant back.

    The read is pruned to the tenant's partition; the schema is validated
    against the table config (P12) before use.
    """
    h, l, a = si.invoices(spark, d), si.invoice_line_items(spark, d), si.charted_accounts(spark, d)
    lines = lt.build_lines(h, l, a, si.INVOICE_PLAN)
    train = lookup.missing_ids(lines, si.eval_set(spark, d), "invoice_id", "source_id")
    path = scratch_path(spark, "raw_lines")
    train.repartition("table_name", "tenant_id").write.partitionBy("table_name", "tenant_id").parquet(path)
    back = read_artefact(spark, path).filter((F.col("table_name") == "accrec_accpay") & (F.col("tenant_id") == "7"))
    bad = rq.validate_schema(back, table_name="accrec_accpay", columns=None,
                             categorical=("description", "account_name", "source_type"),
                             numeric=("line_amount", "tax_amount"), target="account_code", date_col="journal_date")
    if bad.limit(1).count():
        raise ValueError("raw table does not match its config")
    return back


@query("catalog_columns")
def catalog_columns_q(spark, d):
    """(table, column, type, nullable, ordinal) of the given tables (schema only)."""
    return catalog_columns(spark, {t: read_table(spark, d, t) for t in GIVEN_TABLES})


@query("validate_schema")
def validate_schema_q(spark, d):
    """Violations of a table config that names columns the order lines do not have."""
    lines = si.order_features(spark, d)
    return rq.validate_schema(lines, table_name="accrec_accpay", columns=lines.columns + ["o_comment"],
                              categorical=("o_orderstatus", "c_mktsegment", "o_clerk"),
                              numeric=("o_totalprice", "o_discount"), target="o_orderpriority",
                              date_col="o_orderdate")


@query("class_count_map", ORDER_BASE + """
SELECT tenant_id, table_name, string_agg(cls || '=' || n, ',' ORDER BY cls) AS class_counts FROM cnt GROUP BY ALL""")
def class_count_map(spark, d):
    """A3 nested form: one map<class, count> per (tenant, table), shown as sorted text."""
    model, _ = order_model(spark, d)
    maps = profile.class_count_map(model.counts, KEYS)
    entries = F.array_sort(F.map_entries("class_counts"))
    return maps.withColumn("class_counts", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("explanation_records", ORDER_BASE + """
SELECT nb.tenant_id, nb.table_name, q_id, rank, t_id, t_label, round(d2, 6) AS d2, distance, b.o_orderstatus AS t_o_orderstatus,
       b.c_mktsegment AS t_c_mktsegment, b.o_totalprice AS t_o_totalprice
FROM nb JOIN base b ON b.o_orderkey = nb.t_id""")
def explanation_records(spark, d):
    """Each neighbour of a held-out line with its record."""
    model, queries = order_model(spark, d)
    nb = scoring.neighbors(model, queries)
    return scoring.explanation_records(reported(nb), model.ref, KEYS, "o_orderkey",
                                       ["o_orderstatus", "c_mktsegment", "o_totalprice"])


@query("train_summary", ORDER_BASE.replace("is_q} AS is_q", "is_q} AS is_q") + """,
pairs2 AS (SELECT q.tenant_id, q.table_name, q.o_orderkey AS q_id, q.cls AS truth, r.o_orderkey AS t_id, r.cls AS t_label,
                  ((q.x - r.x) / q.s) * ((q.x - r.x) / q.s)
                    + CASE WHEN q.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END
                    + CASE WHEN q.c_mktsegment IS NOT DISTINCT FROM r.c_mktsegment THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS d2
           FROM rz q JOIN rz r ON q.tenant_id = r.tenant_id AND q.table_name = r.table_name),
nb2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, q_id ORDER BY d2, t_id) AS rank
                       FROM pairs2) WHERE rank <= 7),
pred2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, q_id ORDER BY score DESC, t_label) AS rn
          FROM (SELECT tenant_id, table_name, q_id, truth, t_label,
                       round(sum(CASE WHEN mind2 = 0 THEN (CASE WHEN d2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                                      ELSE sqrt(mind2 / d2) END), 9) AS score
                FROM (SELECT *, min(d2) OVER (PARTITION BY tenant_id, table_name, q_id) AS mind2 FROM nb2)
                GROUP BY tenant_id, table_name, q_id, truth, t_label)) WHERE rn = 1),
acc AS (SELECT tenant_id, table_name, round(avg(CAST(t_label = truth AS DOUBLE)), 9) AS train_accuracy FROM pred2 GROUP BY ALL),
grp AS (SELECT a.tenant_id, a.table_name, count(r.cls) AS n_rows, count(DISTINCT r.cls) AS n_classes
        FROM (SELECT DISTINCT tenant_id, table_name FROM ref0) a LEFT JOIN ref r ON r.tenant_id = a.tenant_id AND r.table_name = a.table_name GROUP BY ALL)
SELECT g.*, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_classes <= 1 THEN 'constant_target'
                 WHEN n_rows < 7 THEN 'too_few_rows' END AS reason,
       CASE WHEN n_rows > 0 AND n_classes > 1 AND n_rows >= 7 THEN 'FINISHED' ELSE 'SKIPPED' END AS state,
       acc.train_accuracy
FROM grp g LEFT JOIN acc USING (tenant_id, table_name)""")
def train_summary(spark, d):
    """Per tenant the training state and the self-scored training accuracy."""
    model, _ = order_model(spark, d)
    return scoring.train_summary(model)


@query("anomalies_union", f"""
SELECT * FROM ({ORDER_BASE},
  pred AS {vote_sql('nb', 'distance')}
  SELECT p.*, b.cls AS booked FROM pred p JOIN base b ON b.o_orderkey = p.q_id
  WHERE p.prediction IS DISTINCT FROM b.cls)
UNION ALL BY NAME
SELECT * FROM ({CUST_BASE},
  pred AS {vote_sql('nb', 'distance')}
  SELECT p.*, c.c_mktsegment AS booked FROM pred p JOIN c ON c.c_custkey = p.q_id
  WHERE p.prediction IS DISTINCT FROM c.c_mktsegment)""")
def anomalies_union(spark, d):
    """Audit findings of two line tables appended into one result."""
    model, queries = order_model(spark, d)
    _, pred = scoring.predict(model, queries)
    booked = queries.select(*KEYS, F.col("o_orderkey").alias("q_id"), F.col("o_orderpriority").alias("booked"))
    a1 = scoring.anomalies(pred.join(booked, list(KEYS) + ["q_id"]), "booked")
    c = customers(spark, d)
    cm = scoring.fit(c, CUSTOMER_SPEC, filter_rare=False)
    pred2 = knn.vote(scoring.neighbors(cm, c, exclude_self=True), KEYS, "distance")
    b2 = c.select(*KEYS, F.col("c_custkey").alias("q_id"), F.col("c_mktsegment").alias("booked"))
    a2 = scoring.anomalies(pred2.join(b2, list(KEYS) + ["q_id"]), "booked")
    return a1.unionByName(a2, allowMissingColumns=True)


# --- lines with gaps, and groups without a model ------------------------------
#: Every kind of gap in the order lines: missing and NaN amounts, missing and unseen segments.
_DIRTY = {"o_totalprice": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN {nan} ELSE o_totalprice END",
          "c_mktsegment": "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 13 = 0 AND {q} THEN 'UNSEEN' ELSE c_mktsegment END"}


def dirty_lines(df, is_query: bool):
    return (df.withColumn("o_totalprice", F.expr(_DIRTY["o_totalprice"].format(nan="double('NaN')")))
              .withColumn("c_mktsegment", F.expr(_DIRTY["c_mktsegment"].format(q=str(is_query).lower()))))


_DIRTY_BASE = ORDER_BASE.replace("o_totalprice,\n", _DIRTY["o_totalprice"].format(nan="'NaN'::DOUBLE") + " AS o_totalprice,\n", 1).replace(
    "o_orderstatus, c_mktsegment, CASE", "o_orderstatus, " + _DIRTY["c_mktsegment"].format(q="(" + HOLDOUT.format(c="o_orderkey") + ")") + " AS c_mktsegment, CASE", 1).replace(
    "coalesce(o_totalprice, 0)", "CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN 0 ELSE o_totalprice END").replace(
    "coalesce(q.o_totalprice, 0)", "CASE WHEN q.o_totalprice IS NULL OR isnan(q.o_totalprice) THEN 0 ELSE q.o_totalprice END")


@query("knn_gaps", _DIRTY_BASE + f" SELECT {NB_COLUMNS} FROM nb")
def knn_gaps(spark, d):
    """neighbours of lines with missing and NaN amounts, missing and unseen categories."""
    train, queries = order_split(spark, d)
    model = scoring.fit(dirty_lines(train, False), ORDER_SPEC)
    return reported(scoring.neighbors(model, dirty_lines(queries, True)))


#: Tenants of the stand-in whose training fails a rule: one class only, a single row, never trained.
_SKIP_SQL = ORDER_BASE.split("ref0 AS", 1)[0] + """
tr AS (SELECT tenant_id, CASE WHEN tenant_id = '19' THEN 'X' ELSE cls END AS cls FROM base
       WHERE NOT is_q AND tenant_id <> '24' AND (tenant_id <> '18' OR o_orderkey % 40 = 1)),
c AS (SELECT tenant_id, cls, count(*) AS n FROM tr GROUP BY ALL),
g AS (SELECT tenant_id, sum(CASE WHEN n >= 5 THEN n ELSE 0 END) AS n_rows, sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) AS n_classes FROM c GROUP BY ALL),
r AS (SELECT tenant_id, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_classes <= 1 THEN 'constant_target' WHEN n_rows < 7 THEN 'too_few_rows' END AS reason FROM g)
SELECT b.tenant_id, b.table_name, b.o_orderkey AS q_id, CASE WHEN r.tenant_id IS NULL THEN 'no_model' ELSE reason END AS reason
FROM base b LEFT JOIN r USING (tenant_id) WHERE is_q AND (r.tenant_id IS NULL OR reason IS NOT NULL)"""


@query("rejected_lines", _SKIP_SQL)
def rejected_lines(spark, d):
    """Held-out lines of tenants whose training was skipped or never saw them, with the reason."""
    train, queries = order_split(spark, d)
    t = F.col("tenant_id")
    train = train.filter((t != "24") & ((t != "18") | (F.col("o_orderkey") % 40 == 1))).withColumn(
        "o_orderpriority", F.when(t == "19", F.lit("X")).otherwise(F.col("o_orderpriority")))
    return scoring.rejected(scoring.fit(train, ORDER_SPEC), queries)


@query("registry_roundtrip", ORDER_BASE + f" SELECT * FROM {vote_sql('nb', 'distance')}")
def registry_roundtrip(spark, d):
    """Save two runs of the model, load the latest one and score with it."""
    model, queries = order_model(spark, d)
    base = scratch_path(spark, "models")
    scoring.save_model(model, base, "2024-01-31-23-59-59")
    scoring.save_model(model, base, "2024-02-01-00-00-00")
    _, pred = scoring.predict(scoring.load_model(spark, base, ORDER_SPEC), queries)
    return pred
