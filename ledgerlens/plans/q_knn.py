"""Catalogue: feature stats, kNN scoring, audit (SURVEY §7.3 groups "stats" and "kNN").

Stand-in model (SURVEY §7.3.1): ``orders JOIN customer``; tenant = nation,
id ``o_orderkey``, class ``o_orderpriority``, numeric ``o_totalprice``,
categorical ``o_orderstatus`` and ``c_mktsegment``; query side = the
hold-out orders of the evaluation set, reference side = the rest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.config import ModelSpec
from ledgerlens.operators import features as fe
from ledgerlens.operators import knn, lookup, scoring
from ledgerlens.plans.catalog import query
from ledgerlens.plans.sql_standins import HOLDOUT, ILI, INV, OF, with_
from ledgerlens.session import materialize
from ledgerlens.sources import line_tables as lt
from ledgerlens.sources import standins as si
from ledgerlens.sources.tables import read_table

KEYS = ("tenant_id", "table_name")

ORDER_SPEC = ModelSpec(id_col="o_orderkey", target="o_orderpriority",
                       categorical=("o_orderstatus", "c_mktsegment"), numeric=("o_totalprice",),
                       date_col="o_orderdate", k=7, weights="distance")
CUSTOMER_SPEC = ModelSpec(id_col="c_custkey", target="c_mktsegment", categorical=(),
                          numeric=("c_acctbal",), k=7)
VECTOR_SPEC = ModelSpec(id_col="vec_id", target="label", vector="embedding", k=7)


def order_split(spark, d):
    """(train, queries): queries = evaluation-set orders, train = the rest."""
    lines = si.order_features(spark, d)
    ev = si.eval_set(spark, d).select("tenant_id", "table_name", F.col("id").alias("o_orderkey"))
    train = lookup.remove_holdout(lines, ev, keys=("tenant_id", "table_name", "o_orderkey"))
    queries = lookup.lookup_ids(lines, ev, ["tenant_id", "table_name", "o_orderkey"])
    return train, queries


def order_model(spark, d):
    train, queries = order_split(spark, d)
    return scoring.fit(train, ORDER_SPEC), queries


# ---------------------------------------------------------------------------
# oracle SQL: brute force over all pairs of a group (fine at sf0.01)
_NA = "CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) IN ('None', 'nan', 'NaN') THEN 'NOT_APPLICABLE' ELSE CAST({c} AS VARCHAR) END"

ORDER_BASE = with_(OF) + f""",
base AS (SELECT tenant_id, table_name, o_orderkey, o_orderstatus, c_mktsegment, o_totalprice,
                {_NA.format(c='o_orderpriority')} AS cls, {HOLDOUT.format(c='o_orderkey')} AS is_q FROM of),
ref0 AS (SELECT * FROM base WHERE NOT is_q),
cnt AS (SELECT tenant_id, table_name, cls, count(*) AS n FROM ref0 GROUP BY ALL),
ref AS (SELECT ref0.* FROM ref0 JOIN cnt USING (tenant_id, table_name, cls) WHERE cnt.n >= 5),
st AS (SELECT tenant_id, table_name, avg(coalesce(o_totalprice, 0)) AS m,
              CASE WHEN stddev_pop(coalesce(o_totalprice, 0)) = 0 OR stddev_pop(coalesce(o_totalprice, 0)) IS NULL
                   THEN 1.0::DOUBLE ELSE stddev_pop(coalesce(o_totalprice, 0)) END AS s
       FROM ref GROUP BY ALL),
rz AS (SELECT ref.*, s, coalesce(o_totalprice, 0) AS x FROM ref JOIN st USING (tenant_id, table_name)),
qz AS (SELECT q.*, s, coalesce(q.o_totalprice, 0) AS x, (coalesce(q.o_totalprice, 0) - m) / s AS z,
              EXISTS (SELECT 1 FROM ref r WHERE r.tenant_id = q.tenant_id AND r.table_name = q.table_name
                      AND r.o_orderstatus IS NOT DISTINCT FROM q.o_orderstatus) AS k1,
              EXISTS (SELECT 1 FROM ref r WHERE r.tenant_id = q.tenant_id AND r.table_name = q.table_name
                      AND r.c_mktsegment IS NOT DISTINCT FROM q.c_mktsegment) AS k2
       FROM base q JOIN st USING (tenant_id, table_name) WHERE q.is_q),
pairs AS (SELECT q.tenant_id, q.table_name, q.o_orderkey AS q_id, r.o_orderkey AS t_id, r.cls AS t_label,
                 ((q.x - r.x) / q.s) * ((q.x - r.x) / q.s)
                   + CASE WHEN q.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus THEN 0.0::DOUBLE
                          WHEN q.k1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
                   + CASE WHEN q.c_mktsegment IS NOT DISTINCT FROM r.c_mktsegment THEN 0.0::DOUBLE
                          WHEN q.k2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS d2
          FROM qz q JOIN rz r ON q.tenant_id = r.tenant_id AND q.table_name = r.table_name),
nb AS (SELECT *, round(sqrt(d2), 6) AS distance FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, q_id ORDER BY d2, t_id) AS rank
         FROM pairs) WHERE rank <= 7)"""


#: Reported columns of a neighbour list; ranking and voting use the unrounded distance.
NB_COLUMNS = "tenant_id, table_name, q_id, rank, t_id, t_label, round(d2, 6) AS d2, distance"


def reported(nb):
    """Neighbours with the squared distance rounded for output."""
    return nb.withColumn("d2", F.round("d2", 6))


def vote_sql(nb: str, weights: str) -> str:
    """``weights``: uniform, distance, or column (the rows of ``nb`` have theirs in ``weights``)."""
    by_distance = "CASE WHEN mind2 = 0 THEN (CASE WHEN d2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ELSE sqrt(mind2 / d2) END"
    w = {"uniform": "1.0::DOUBLE", "distance": by_distance, "column": f"CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE ELSE {by_distance} END"}[weights]
    return f"""(SELECT tenant_id, table_name, q_id, t_label AS prediction, score FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, q_id ORDER BY score DESC, t_label) AS rn
  FROM (SELECT tenant_id, table_name, q_id, t_label, round(sum(w / tw), 9) AS score
        FROM (SELECT *, sum(w) OVER (PARTITION BY tenant_id, table_name, q_id) AS tw
              FROM (SELECT *, {w} AS w FROM (SELECT *, min(d2) OVER (PARTITION BY tenant_id, table_name, q_id) AS mind2 FROM {nb})))
        GROUP BY tenant_id, table_name, q_id, t_label)) WHERE rn = 1)"""


# ---------------------------------------------------------------------------


@query("scaler_stats", ORDER_BASE + """
SELECT tenant_id, table_name, 'o_totalprice' AS feature, round(m, 6) AS mean, round(s, 6) AS std FROM st""")
def scaler_stats(spark, d):
    model, _ = order_model(spark, d)
    st = fe.numeric_stats(model.ref, KEYS, ORDER_SPEC.numeric)
    return st.select(*KEYS, "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("category_stats", ORDER_BASE + """
SELECT DISTINCT tenant_id, table_name, 'o_orderstatus' AS feature, o_orderstatus AS value FROM ref
UNION ALL
SELECT DISTINCT tenant_id, table_name, 'c_mktsegment' AS feature, c_mktsegment AS value FROM ref""")
def category_stats(spark, d):
    model, _ = order_model(spark, d)
    return fe.category_values(model.ref, KEYS, ORDER_SPEC.categorical)


@query("zscore", ORDER_BASE + """
SELECT tenant_id, table_name, o_orderkey, round(z, 6) AS z_o_totalprice, k1 AS known_o_orderstatus,
       k2 AS known_c_mktsegment FROM qz""")
def zscore(spark, d):
    model, queries = order_model(spark, d)
    z = fe.standardize(queries, model.stats, KEYS, ORDER_SPEC.numeric)
    z = fe.known_flags(z, model.ref, KEYS, ORDER_SPEC.categorical)
    return z.select(*KEYS, "o_orderkey", F.round("z_o_totalprice", 6).alias("z_o_totalprice"), "known_o_orderstatus", "known_c_mktsegment")


@query("onehot_distance", ORDER_BASE + """,
prev AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_key
         FROM of),
prevq AS (SELECT qz.*, prev.prev_key FROM qz JOIN prev USING (o_orderkey))
SELECT q.tenant_id, q.table_name, q.o_orderkey AS q_id, r.o_orderkey AS t_id,
       round(((q.x - r.x) / q.s) * ((q.x - r.x) / q.s)
         + CASE WHEN q.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus THEN 0.0::DOUBLE
                WHEN q.k1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
         + CASE WHEN q.c_mktsegment IS NOT DISTINCT FROM r.c_mktsegment THEN 0.0::DOUBLE
                WHEN q.k2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS d2
FROM prevq q JOIN rz r ON r.o_orderkey = q.prev_key AND r.tenant_id = q.tenant_id""")
def onehot_distance(spark, d):
    """distance of each query order to its customer's previous order (if a reference row)."""
    model, queries = order_model(spark, d)
    from pyspark.sql import Window
    qz = fe.with_scale(queries, model.stats, KEYS, ORDER_SPEC.numeric)
    qz = fe.known_flags(qz, model.ref, KEYS, ORDER_SPEC.categorical)
    allq = si.order_features(spark, d).select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    prev = allq.withColumn("prev_key", F.lag("o_orderkey").over(w)).select("o_orderkey", "prev_key")
    qz = qz.join(prev, "o_orderkey")
    rz = fe.with_scale(model.ref, model.stats, KEYS, ORDER_SPEC.numeric)
    q = qz.select(*KEYS, F.col("o_orderkey").alias("q_id"), "prev_key",
                  F.col("x_o_totalprice").alias("qn0"), F.col("s_o_totalprice").alias("qs0"), F.col("o_orderstatus").alias("qc0"),
                  F.col("c_mktsegment").alias("qc1"), F.col("known_o_orderstatus").alias("qk0"),
                  F.col("known_c_mktsegment").alias("qk1"))
    t = rz.select(F.col("tenant_id").alias("t_tenant"), F.col("o_orderkey").alias("t_id"),
                  F.col("x_o_totalprice").alias("tn0"), F.col("o_orderstatus").alias("tc0"),
                  F.col("c_mktsegment").alias("tc1"))
    j = q.join(t, (F.col("prev_key") == F.col("t_id")) & (F.col("tenant_id") == F.col("t_tenant")))
    return j.select(*KEYS, "q_id", "t_id",
                    F.round(knn.pair_d2("q", "t", 1, 2, "qk", "qs"), 6).alias("d2"))


@query("class_frequency", ORDER_BASE + """,
tot AS (SELECT tenant_id, table_name, sum(n) AS tot FROM cnt GROUP BY ALL)
SELECT q.tenant_id, q.table_name, q.o_orderkey, q.cls AS booked,
       round(coalesce(CASE WHEN c.n >= 5 THEN c.n / t.tot ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 9) AS class_frequency
FROM base q LEFT JOIN cnt c ON c.tenant_id = q.tenant_id AND c.table_name = q.table_name AND c.cls = q.cls
LEFT JOIN tot t ON t.tenant_id = q.tenant_id AND t.table_name = q.table_name
WHERE q.is_q""")
def class_frequency(spark, d):
    model, queries = order_model(spark, d)
    q = queries.select(*KEYS, "o_orderkey", F.col("o_orderpriority").alias("booked"))
    return scoring.class_frequency(model, q, "booked")


@query("knn_predict", ORDER_BASE + f"""
SELECT *, 'distance' AS weights FROM {vote_sql('nb', 'distance')}
UNION ALL
SELECT *, 'uniform' AS weights FROM {vote_sql('nb', 'uniform')}""")
def knn_predict(spark, d):
    """J9 + A11 with both weightings from one neighbour computation."""
    model, queries = order_model(spark, d)
    nb = scoring.neighbors(model, queries)
    return (knn.vote(nb, KEYS, "distance").withColumn("weights", F.lit("distance"))
            .unionByName(knn.vote(nb, KEYS, "uniform").withColumn("weights", F.lit("uniform"))))


@query("knn_explanations", ORDER_BASE + f"SELECT {NB_COLUMNS} FROM nb")
def knn_explanations(spark, d):
    """C6 explanations: the k neighbours of each query line with rank and distance."""
    model, queries = order_model(spark, d)
    return reported(scoring.neighbors(model, queries))


@query("neighbor_distance_stats", ORDER_BASE + """
SELECT tenant_id, table_name, q_id, min(distance) AS min_distance, max(distance) AS max_distance,
       round(avg(distance), 6) AS avg_distance FROM nb GROUP BY ALL""")
def neighbor_distance_stats(spark, d):
    model, queries = order_model(spark, d)
    return knn.distance_stats(scoring.neighbors(model, queries), KEYS)


@query("anomalies", ORDER_BASE + f""",
pred AS {vote_sql('nb', 'distance')}
SELECT p.*, b.cls AS booked FROM pred p JOIN base b ON b.o_orderkey = p.q_id
WHERE p.prediction IS DISTINCT FROM b.cls""")
def anomalies(spark, d):
    """Held-out lines whose predicted class differs from the booked one."""
    model, queries = order_model(spark, d)
    _, pred = scoring.predict(model, queries)
    booked = queries.select(*KEYS, F.col("o_orderkey").alias("q_id"), F.col("o_orderpriority").alias("booked"))
    return scoring.anomalies(pred.join(booked, list(KEYS) + ["q_id"]), "booked")


@query("audit", ORDER_BASE + f""",
pred AS {vote_sql('nb', 'distance')},
tot AS (SELECT tenant_id, table_name, sum(n) AS tot FROM cnt GROUP BY ALL)
SELECT p.*, b.cls AS booked,
       round(coalesce(CASE WHEN c.n >= 5 THEN c.n / t.tot ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 9) AS class_frequency
FROM pred p JOIN base b ON b.o_orderkey = p.q_id
LEFT JOIN cnt c ON c.tenant_id = p.tenant_id AND c.table_name = p.table_name AND c.cls = b.cls
LEFT JOIN tot t ON t.tenant_id = p.tenant_id AND t.table_name = p.table_name
WHERE p.prediction IS DISTINCT FROM b.cls""")
def audit(spark, d):
    """Flagship (C18): fit on training lines minus hold-out, score hold-out, keep disagreements."""
    train, queries = order_split(spark, d)
    return scoring.audit(scoring.fit(train, ORDER_SPEC), queries)


# --- customer self-kNN (leave-one-out within nation) -------------------------
CUST_BASE = """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS tenant_id, 'customers' AS table_name,
                   c_custkey, c_acctbal, c_mktsegment FROM customer),
st AS (SELECT tenant_id, table_name, avg(coalesce(c_acctbal, 0)) AS m,
              CASE WHEN stddev_pop(coalesce(c_acctbal, 0)) = 0 THEN 1.0::DOUBLE
                   ELSE stddev_pop(coalesce(c_acctbal, 0)) END AS s FROM c GROUP BY ALL),
z AS (SELECT c.*, s, coalesce(c_acctbal, 0) AS x FROM c JOIN st USING (tenant_id, table_name)),
pairs AS (SELECT q.tenant_id, q.table_name, q.c_custkey AS q_id, t.c_custkey AS t_id, t.c_mktsegment AS t_label,
                 ((q.x - t.x) / q.s) * ((q.x - t.x) / q.s) AS d2
          FROM z q JOIN z t ON q.tenant_id = t.tenant_id AND q.table_name = t.table_name AND q.c_custkey <> t.c_custkey),
nb AS (SELECT *, round(sqrt(d2), 6) AS distance FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, q_id ORDER BY d2, t_id) AS rank
         FROM pairs) WHERE rank <= 7)"""


def customers(spark, d):
    c = read_table(spark, d, "customer")
    return c.select(F.col("c_nationkey").cast("string").alias("tenant_id"),
                    F.lit("customers").alias("table_name"), "c_custkey", "c_acctbal", "c_mktsegment")


@query("knn_neighbors", CUST_BASE + f" SELECT {NB_COLUMNS} FROM nb")
def knn_neighbors(spark, d):
    """J9 self-join: each customer's 7 nearest other customers of its nation."""
    c = customers(spark, d)
    model = scoring.fit(c, CUSTOMER_SPEC, filter_rare=False)
    return reported(scoring.neighbors(model, c, exclude_self=True))


# --- dense vectors --------------------------------------------------------------
VEC_BASE = f"""WITH v AS (SELECT 'all' AS tenant_id, 'embeddings' AS table_name, vec_id, embedding,
                   CAST(label AS VARCHAR) AS label, {HOLDOUT.format(c='vec_id')} AS is_q FROM embeddings),
ref0 AS (SELECT * FROM v WHERE NOT is_q),
cnt AS (SELECT tenant_id, table_name, label, count(*) AS n FROM ref0 GROUP BY ALL),
ref AS (SELECT ref0.* FROM ref0 JOIN cnt USING (tenant_id, table_name, label) WHERE cnt.n >= 5),
pairs AS (SELECT q.tenant_id, q.table_name, q.vec_id AS q_id, r.vec_id AS t_id, r.label AS t_label,
                 list_sum(list_transform(list_zip(q.embedding, r.embedding),
                       lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d2
          FROM v q JOIN ref r ON q.tenant_id = r.tenant_id WHERE q.is_q),
nb AS (SELECT *, round(sqrt(d2), 6) AS distance FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, q_id ORDER BY d2, t_id) AS rank
         FROM pairs) WHERE rank <= 7)"""


@query("knn_vectors", VEC_BASE + f" SELECT * FROM {vote_sql('nb', 'distance')}")
def knn_vectors(spark, d):
    """J9 over a 64-d dense vector feature (embeddings, label 0-9)."""
    e = read_table(spark, d, "embeddings").select(
        F.lit("all").alias("tenant_id"), F.lit("embeddings").alias("table_name"), "vec_id", "embedding",
        F.col("label").cast("string").alias("label"))
    is_q = si.holdout_flag("vec_id")
    model = scoring.fit(e.filter(~is_q), VECTOR_SPEC)
    _, pred = scoring.predict(model, e.filter(is_q))
    return pred


# --- invoice lines with the features of the account-mapping application -----------
LINE_SPEC = ModelSpec(id_col="line_item_id", target="account_code", categorical=("description", "source_type", "contact_name", "item_code"),
                      numeric=("line_amount",), date_col="journal_date")


def line_split(spark, d):
    """(train, queries): first lines of invoices, split by the evaluation set's line ids."""
    columns = [*LINE_SPEC.group_keys, LINE_SPEC.id_col, LINE_SPEC.target, *LINE_SPEC.features, LINE_SPEC.date_col]
    lines = lt.written_first_lines(si.invoices(spark, d), si.invoice_line_items(spark, d), si.charted_accounts(spark, d), si.INVOICE_PLAN, columns)
    ev = si.eval_lines(spark, d)
    return lookup.missing_ids(lines, ev, "line_item_id"), materialize(lookup.lookup_ids(lines, ev, "line_item_id"), "asked_lines")


_CATS = LINE_SPEC.categorical
LINE_BASE = with_(INV, ILI) + f""",
base AS (SELECT * EXCLUDE (rn) FROM (
  SELECT 'accrec_accpay' AS table_name, i.tenant_id, l.line_item_id, l.account_code AS cls, l.description, i.type AS source_type, i.contact_name, l.item_code,
         l.line_amount AS x, i.date AS journal_date, {HOLDOUT.format(c='l.line_item_id')} AS is_q,
         row_number() OVER (PARTITION BY l.invoice_id ORDER BY l.line_no, l.part_no, l.supp_no) AS rn
  FROM ili l JOIN inv i ON l.invoice_unique_id = i.id) WHERE rn = 1),
ref0 AS (SELECT * FROM base WHERE NOT is_q),
cnt AS (SELECT tenant_id, table_name, cls, count(*) AS n FROM ref0 GROUP BY ALL),
ref1 AS (SELECT ref0.* FROM ref0 JOIN cnt USING (tenant_id, table_name, cls) WHERE cnt.n >= 5),
st AS (SELECT tenant_id, table_name, CASE WHEN stddev_pop(x) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(x) END AS s,
              {", ".join(f"count(DISTINCT {c}) > 1 AS u_{c}" for c in _CATS)}, count(DISTINCT x) > 1 AS u_x
       FROM ref1 GROUP BY ALL HAVING count(DISTINCT cls) > 1 AND count(*) >= 7),
ref AS (SELECT ref1.* FROM ref1 JOIN st USING (tenant_id, table_name)),
qz AS (SELECT q.*, st.* EXCLUDE (tenant_id, table_name),
              {", ".join(f"EXISTS (SELECT 1 FROM ref r WHERE r.tenant_id = q.tenant_id AND r.{c} = q.{c}) AS k_{c}" for c in _CATS)}
       FROM base q JOIN st USING (tenant_id, table_name) WHERE is_q),
pairs AS (SELECT q.tenant_id, q.table_name, q.line_item_id AS q_id, r.line_item_id AS t_id, r.cls AS t_label,
                 CASE WHEN u_x THEN ((q.x - r.x) / s) * ((q.x - r.x) / s) ELSE 0.0::DOUBLE END
                 + {" + ".join(f"CASE WHEN NOT u_{c} OR q.{c} = r.{c} THEN 0.0::DOUBLE WHEN k_{c} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END" for c in _CATS)} AS d2
          FROM qz q JOIN ref r ON q.tenant_id = r.tenant_id AND q.table_name = r.table_name),
nb AS (SELECT *, round(sqrt(d2), 6) AS distance FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, q_id ORDER BY d2, t_id) AS rank FROM pairs) WHERE rank <= 7)"""


@query("knn_invoice_lines", LINE_BASE + f" SELECT {NB_COLUMNS} FROM nb")
def knn_invoice_lines(spark, d):
    """J9 on invoice lines: four categorical features, among them contact and item, and the amount."""
    train, queries = line_split(spark, d)
    return reported(scoring.neighbors(scoring.fit(train, LINE_SPEC), queries))


_RANGE = ("1995-01-01", "1997-12-31")


def _found_sql(base: str, rows: str, id_col: str, date_col: str) -> str:
    return f"""SELECT * FROM ({base},
pred AS {vote_sql('nb', 'distance')},
tot AS (SELECT tenant_id, table_name, sum(n) AS tot FROM cnt GROUP BY ALL)
SELECT p.* REPLACE (CAST(p.q_id AS VARCHAR) AS q_id), b.cls AS booked,
       round(coalesce(CASE WHEN c.n >= 5 THEN c.n / t.tot ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 9) AS class_frequency
FROM pred p JOIN {rows} b ON b.{id_col} = p.q_id
LEFT JOIN cnt c ON c.tenant_id = p.tenant_id AND c.table_name = p.table_name AND c.cls = b.cls
LEFT JOIN tot t ON t.tenant_id = p.tenant_id AND t.table_name = p.table_name
WHERE p.prediction IS DISTINCT FROM b.cls AND b.{date_col} BETWEEN DATE '{_RANGE[0]}' AND DATE '{_RANGE[1]}')"""


@query("audit_range", _found_sql(ORDER_BASE.replace("o_totalprice,\n", "o_totalprice, o_orderdate,\n", 1), "base", "o_orderkey", "o_orderdate")
       + " UNION ALL BY NAME " + _found_sql(LINE_BASE, "base", "line_item_id", "journal_date"))
def audit_range(spark, d):
    """Findings of two line tables in a date range, all tenants."""
    train, queries = order_split(spark, d)
    lines, line_queries = line_split(spark, d)
    return scoring.audit_range([(scoring.fit(train, ORDER_SPEC), queries), (scoring.fit(lines, LINE_SPEC), line_queries)], *_RANGE)


@query("result_rows", ORDER_BASE + f""",
pred AS {vote_sql('nb', 'distance')},
why AS (SELECT q_id, string_agg(concat_ws(':', rank, t_id, t_label, CAST(round(distance * 1000000) AS BIGINT)), ' ' ORDER BY rank) AS explanations FROM nb GROUP BY q_id),
tot AS (SELECT tenant_id, table_name, sum(n) AS tot FROM cnt GROUP BY ALL)
SELECT p.*, b.cls AS booked, why.explanations,
       round(coalesce(CASE WHEN c.n >= 5 THEN c.n / t.tot ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 9) AS class_frequency
FROM pred p JOIN base b ON b.o_orderkey = p.q_id JOIN why ON why.q_id = p.q_id
LEFT JOIN cnt c ON c.tenant_id = p.tenant_id AND c.table_name = p.table_name AND c.cls = b.cls
LEFT JOIN tot t ON t.tenant_id = p.tenant_id AND t.table_name = p.table_name""")
def result_rows(spark, d):
    """The whole answer per held-out line; explanations shown as text, distances in millionths."""
    model, queries = order_model(spark, d)
    one = lambda e: F.concat_ws(":", e["rank"].cast("string"), e["t_id"].cast("string"), e["t_label"], F.round(e["distance"] * 1000000).cast("long").cast("string"))
    return scoring.result_rows(model, queries).withColumn("explanations", F.array_join(F.transform("explanations", one), " "))


def _named_sql(features, used: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {used} {u} THEN '{c}' END" for c, u in features) + "], lambda x: x IS NOT NULL), ',')"


_LINE_CATS = [(c, f"u_{c}") for c in _CATS]


@query("model_cards", LINE_BASE + f""",
cc AS (SELECT tenant_id, table_name, string_agg(cls || ':' || n, ',' ORDER BY cls) AS class_counts,
              coalesce(string_agg(cls, ',' ORDER BY cls) FILTER (n < 5), '') AS removed_classes FROM cnt GROUP BY ALL),
ns AS (SELECT tenant_id, table_name, count(*) AS num_samples, {", ".join(f"count(DISTINCT {c}) AS d_{c}" for c in _CATS)} FROM ref GROUP BY ALL)
SELECT tenant_id, table_name, 'account_code' AS target_variable, {_named_sql(_LINE_CATS, "")} AS categorical_features, CASE WHEN u_x THEN 'line_amount' ELSE '' END AS numerical_features,
       {_named_sql([*_LINE_CATS, ("line_amount", "u_x")], "NOT")} AS constant_columns, 7 AS n_neighbors, 'distance' AS weights, 'spec' AS source, class_counts, removed_classes, num_samples,
       CAST(CAST(u_x AS INTEGER) + {" + ".join(f"CAST(u_{c} AS INTEGER) * d_{c}" for c in _CATS)} AS BIGINT) AS input_dim
FROM st JOIN cc USING (tenant_id, table_name) JOIN ns USING (tenant_id, table_name)""")
def model_cards(spark, d):
    """What every tenant's invoice-line model was made with; lists and counts shown as text."""
    train, _ = line_split(spark, d)
    card = scoring.model_card(scoring.fit(train, LINE_SPEC)).drop("run_ts")
    counts = F.transform(F.array_sort(F.map_entries("class_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    lists = ["categorical_features", "numerical_features", "constant_columns", "removed_classes"]
    return card.withColumns({"class_counts": F.array_join(counts, ","), **{c: F.array_join(c, ",") for c in lists}})
