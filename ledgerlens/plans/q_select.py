"""Catalogue: model selection (SURVEY §7.3 group "selection").

Stand-in: order lines per nation (``q_knn``), target ``o_orderpriority``,
numeric ``o_totalprice``, ``c_acctbal``, categorical ``o_orderstatus``,
``c_mktsegment``; cleaned as for training (F1 + rare-class filter).
Sampling runs on ``lineitem`` per return flag (groups above 10 000 rows).
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ledgerlens.operators import selection as sel
from ledgerlens.operators.scoring import fit
from ledgerlens.plans.catalog import query
from ledgerlens.plans.q_knn import KEYS
from ledgerlens.plans.sql_standins import OF, with_
from ledgerlens.sources import standins as si
from ledgerlens.sources.tables import read_table
from ledgerlens.config import SELECTION_MIN_PER_CLASS, SELECTION_SAMPLE_ROWS, ModelSpec
from ledgerlens.session import materialize

NUM = ("o_totalprice", "c_acctbal")
CAT = ("o_orderstatus", "c_mktsegment")
FEATS = sorted(NUM + CAT)
SEL_SPEC = ModelSpec(id_col="o_orderkey", target="o_orderpriority", numeric=NUM, categorical=CAT)


def selection_input(spark, d):
    """Cleaned order lines (C1: target cleaning + rare-class filter) with fold ids."""
    model = fit(si.order_features(spark, d), SEL_SPEC)
    return model.ref


def selection_sample(spark, d):
    """At most 10 000 rows per nation, with at least 5 of each class."""
    return sel.sample_min_per_class(selection_input(spark, d), KEYS, "o_orderpriority", "o_orderkey")


def with_folds(spark, d):
    return sel.stratified_folds(selection_input(spark, d), KEYS, "o_orderpriority", "o_orderkey")


_NA = "CASE WHEN o_orderpriority IS NULL OR o_orderpriority IN ('None', 'nan', 'NaN') THEN 'NOT_APPLICABLE' ELSE o_orderpriority END"

SEL_BASE = with_(OF) + f""",
b0 AS (SELECT tenant_id, table_name, o_orderkey AS id, {_NA} AS cls, o_totalprice, c_acctbal, o_orderstatus, c_mktsegment FROM of),
cnt AS (SELECT tenant_id, table_name, cls, count(*) AS n FROM b0 GROUP BY ALL),
s0 AS (SELECT b0.* FROM b0 JOIN cnt USING (tenant_id, table_name, cls) WHERE cnt.n >= 5),
s AS (SELECT *, CAST((row_number() OVER (PARTITION BY tenant_id, table_name, cls
                                          ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) - 1) % 5 AS INTEGER) AS fold
      FROM s0)"""


def _cands_sql(subsets: dict[str, list[str]]) -> str:
    """VALUES table of candidate feature subsets (same for every group)."""
    rows = []
    for name, fs in subsets.items():
        flags = ", ".join("true" if f in fs else "false" for f in FEATS)
        rows.append(f"('{name}', {len(fs)}, {flags})")
    cols = ", ".join(f"use_{f}" for f in FEATS)
    return f"cset(cand, n_features, {cols}) AS (VALUES {', '.join(rows)})"


def sample_sql(rows: int = SELECTION_SAMPLE_ROWS) -> str:
    """CTEs after SEL_BASE; the last is ``sf``: the selection sample (T6) of at most ``rows`` rows a group, with its folds."""
    return SEL_BASE + f""",
sa AS (SELECT s.*, md5(CAST(id AS VARCHAR) || '|42') AS key, count(*) OVER (PARTITION BY tenant_id, table_name) AS ng FROM s),
sb AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, cls ORDER BY key, id) <= {SELECTION_MIN_PER_CLASS} AS head FROM sa),
sc0 AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY tenant_id, table_name) AS nh,
               row_number() OVER (PARTITION BY tenant_id, table_name, head ORDER BY key, id) AS tr FROM sb),
sf AS (SELECT * EXCLUDE (fold, key, ng, head, nh, tr), CAST((row_number() OVER (PARTITION BY tenant_id, table_name, cls ORDER BY key, id) - 1) % 5 AS INTEGER) AS fold
       FROM sc0 WHERE ng <= {rows} OR head OR tr <= {rows} - nh)"""


def cv_sql(subsets: dict[str, list[str]]) -> str:
    """Brute-force CV over all pairs of each (group, fold, candidate) of the selection sample."""
    u = {f: f"use_{f}" for f in FEATS}
    return sample_sql() + ",\n" + _cands_sql(subsets) + f""",
q AS (SELECT s.*, s.fold AS fold_g, c.* FROM sf s, cset c),
r AS (SELECT s.*, f.fold_g, c.cand FROM sf s, (SELECT unnest(range(5)) AS fold_g) f, cset c WHERE f.fold_g <> s.fold),
st AS (SELECT tenant_id, table_name, fold_g, cand,
              avg(o_totalprice) AS m1,
              CASE WHEN stddev_pop(o_totalprice) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(o_totalprice) END AS s1,
              avg(c_acctbal) AS m2,
              CASE WHEN stddev_pop(c_acctbal) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(c_acctbal) END AS s2
       FROM r GROUP BY ALL),
rz AS (SELECT r.* FROM r JOIN st USING (tenant_id, table_name, fold_g, cand)),
qz AS (SELECT q.*, s1, s2,
              EXISTS (SELECT 1 FROM r WHERE r.tenant_id = q.tenant_id AND r.fold_g = q.fold_g AND r.cand = q.cand
                      AND r.o_orderstatus IS NOT DISTINCT FROM q.o_orderstatus) AS k1,
              EXISTS (SELECT 1 FROM r WHERE r.tenant_id = q.tenant_id AND r.fold_g = q.fold_g AND r.cand = q.cand
                      AND r.c_mktsegment IS NOT DISTINCT FROM q.c_mktsegment) AS k2
       FROM q JOIN st USING (tenant_id, table_name, fold_g, cand)),
pairs AS (SELECT q.tenant_id, q.table_name, q.fold_g, q.cand, q.id AS q_id, q.cls AS truth, t.id AS t_id, t.cls AS t_label,
  CASE WHEN q.{u['o_totalprice']} THEN ((q.o_totalprice - t.o_totalprice) / s1) * ((q.o_totalprice - t.o_totalprice) / s1) ELSE 0.0::DOUBLE END
      + CASE WHEN q.{u['c_acctbal']} THEN ((q.c_acctbal - t.c_acctbal) / s2) * ((q.c_acctbal - t.c_acctbal) / s2) ELSE 0.0::DOUBLE END
      + CASE WHEN q.{u['o_orderstatus']} THEN (CASE WHEN q.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus THEN 0.0::DOUBLE
                                                   WHEN q.k1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) ELSE 0.0::DOUBLE END
      + CASE WHEN q.{u['c_mktsegment']} THEN (CASE WHEN q.c_mktsegment IS NOT DISTINCT FROM t.c_mktsegment THEN 0.0::DOUBLE
                                                  WHEN q.k2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) ELSE 0.0::DOUBLE END AS d2
  FROM qz q JOIN rz t ON q.tenant_id = t.tenant_id AND q.table_name = t.table_name AND q.fold_g = t.fold_g AND q.cand = t.cand),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, fold_g, cand, q_id ORDER BY d2, t_id) AS rank
                      FROM pairs) WHERE rank <= 9),
nbk AS (SELECT nb.*, kk.k FROM nb, (SELECT unnest([3, 5, 7, 9]) AS k) kk WHERE nb.rank <= kk.k),
w AS (SELECT *, min(d2) OVER (PARTITION BY tenant_id, table_name, fold_g, cand, q_id, k) AS mind2 FROM nbk),
sc AS (SELECT tenant_id, table_name, fold_g, cand, q_id, truth, k, t_label, 'uniform' AS weights, round(sum(1.0::DOUBLE), 9) AS score
       FROM w GROUP BY tenant_id, table_name, fold_g, cand, q_id, truth, k, t_label
       UNION ALL
       SELECT tenant_id, table_name, fold_g, cand, q_id, truth, k, t_label, 'distance',
              round(sum(CASE WHEN mind2 = 0 THEN (CASE WHEN d2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                             ELSE sqrt(mind2 / d2) END), 9)
       FROM w GROUP BY tenant_id, table_name, fold_g, cand, q_id, truth, k, t_label),
pred AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, fold_g, cand, q_id, k, weights
                                                   ORDER BY score DESC, t_label) AS rn FROM sc) WHERE rn = 1),
facc AS (SELECT tenant_id, table_name, fold_g, cand, k, weights, avg(CAST(t_label = truth AS DOUBLE)) AS acc
         FROM pred GROUP BY ALL),
cv AS (SELECT tenant_id, table_name, cand, k, weights, round(avg(acc), 9) AS mean_accuracy, count(*) AS n_folds
       FROM facc GROUP BY ALL)"""


FULL = {",".join(FEATS): FEATS}
DROP_ONE = {**FULL, **{",".join(x for x in FEATS if x != f): [x for x in FEATS if x != f] for f in FEATS}}


def _cands_df(groups, subsets):
    """Every group gets the same candidate list (an explode of a literal array)."""
    items = [F.struct(F.lit(name).alias("cand"), F.lit(len(fs)).alias("n_features"),
                      *[F.lit(f in fs).alias(f"use_{f}") for f in FEATS]) for name, fs in subsets.items()]
    return groups.select(*KEYS, F.explode(F.array(*items)).alias("_c")).select(*KEYS, "_c.*")


def _cv(spark, d, subsets):
    s = selection_sample(spark, d)
    s = materialize(sel.stratified_folds(s, KEYS, "o_orderpriority", "o_orderkey"), "cv_sample")
    cands = _cands_df(s.select(*KEYS).distinct(), subsets)
    cv = sel.cv_evaluate(s, cands, KEYS, id_col="o_orderkey", target="o_orderpriority", numeric=NUM, categorical=CAT)
    return cv.join(cands.select(*KEYS, "cand", "n_features"), list(KEYS) + ["cand"])


@query("sample_min_per_class", """
WITH l AS (SELECT l_returnflag AS tenant_id, 'lines' AS table_name,
                  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_item_id,
                  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS cls FROM lineitem),
k AS (SELECT *, md5(line_item_id || '|42') AS key FROM l),
head AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name, cls ORDER BY key, line_item_id) AS r FROM k) WHERE r <= 5),
nh AS (SELECT tenant_id, table_name, count(*) AS nh FROM head GROUP BY ALL),
rest AS (SELECT * FROM k WHERE line_item_id NOT IN (SELECT line_item_id FROM head)),
tail AS (SELECT * EXCLUDE (r, nh) FROM (SELECT rest.*, row_number() OVER (PARTITION BY tenant_id, table_name ORDER BY key, line_item_id) AS r, nh
                                     FROM rest JOIN nh USING (tenant_id, table_name)) WHERE r <= 10000 - nh),
ng AS (SELECT tenant_id, table_name, count(*) AS ng FROM l GROUP BY ALL)
SELECT tenant_id, table_name, line_item_id, cls FROM l JOIN ng USING (tenant_id, table_name) WHERE ng <= 10000
UNION ALL
SELECT tenant_id, table_name, line_item_id, cls FROM (SELECT * FROM head UNION ALL SELECT * FROM tail) x
WHERE tenant_id IN (SELECT tenant_id FROM ng WHERE ng > 10000)""")
def sample_min_per_class(spark, d):
    """10 000 lines per return flag with at least 5 of every quantity class."""
    l = read_table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("tenant_id"), F.lit("lines").alias("table_name"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_item_id"),
        F.col("l_quantity").cast("int").cast("string").alias("cls"))
    return sel.sample_min_per_class(l, KEYS, "cls", "line_item_id")


@query("stratified_folds", SEL_BASE + " SELECT tenant_id, table_name, id AS o_orderkey, fold FROM s")
def stratified_folds(spark, d):
    """5 stratified folds per nation by md5 order."""
    return with_folds(spark, d).select(*KEYS, "o_orderkey", "fold")


def _mi_ctes(discrete: bool, numeric: bool) -> str:
    """CTEs of the mutual information, after SEL_BASE; the last is ``mi``."""
    vals = []
    if discrete:
        vals += [f"SELECT tenant_id, table_name, cls AS y, '{c}' AS feature, CAST({c} AS VARCHAR) AS x FROM s0" for c in CAT]
    if numeric:
        vals += [f"""SELECT tenant_id, table_name, cls AS y, '{c}' AS feature,
                CAST(CAST(floor((rank() OVER (PARTITION BY tenant_id, table_name ORDER BY coalesce({c}, md_{c})) - 1) * 10.0::DOUBLE / n_rows) AS BIGINT) AS VARCHAR) AS x
                FROM s0 JOIN nst USING (tenant_id, table_name)""" for c in NUM]
    vals = "\n UNION ALL ".join(vals)
    nst = ",\nnst AS (SELECT tenant_id, table_name, count(*) AS n_rows, " + ", ".join(f"median({c}) AS md_{c}" for c in NUM) + " FROM s0 GROUP BY ALL)"
    return nst + f""",
lg AS ({vals}),
nxy AS (SELECT tenant_id, table_name, feature, x, y, count(*) AS nxy FROM lg GROUP BY ALL),
nx AS (SELECT tenant_id, table_name, feature, x, sum(nxy) AS nx FROM nxy GROUP BY ALL),
ny AS (SELECT tenant_id, table_name, feature, y, sum(nxy) AS ny FROM nxy GROUP BY ALL),
nn AS (SELECT tenant_id, table_name, feature, sum(nxy) AS n FROM nxy GROUP BY ALL),
mi AS (SELECT tenant_id, table_name, feature, round(sum((nxy / n) * ln(nxy * n / (nx * ny))), 9) AS mi
       FROM nxy JOIN nx USING (tenant_id, table_name, feature, x) JOIN ny USING (tenant_id, table_name, feature, y)
       JOIN nn USING (tenant_id, table_name, feature) GROUP BY ALL)"""


def _digamma_sql(n: str) -> str:
    x = f"({n} + 10.0::DOUBLE)"
    steps = " + ".join(f"1.0::DOUBLE / ({n} + {i})" for i in range(10))
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8) - ({steps}))"


#: Nearest-neighbour estimate by all pairs, after SEL_BASE; the last CTE is ``mik``.
_MI_NEAR = ",\nmst AS (SELECT tenant_id, table_name, " + ", ".join(f"median({c}) AS md_{c}" for c in NUM) + " FROM s0 GROUP BY ALL)" + f""",
mv AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, table_name, feature, y) AS n_y FROM (
  {" UNION ALL ".join(f"SELECT tenant_id, table_name, id, cls AS y, '{c}' AS feature, coalesce({c}, md_{c}) AS x FROM s0 JOIN mst USING (tenant_id, table_name)" for c in NUM)})),
mw AS (SELECT * FROM mv WHERE n_y > 1),
mr AS (SELECT a.tenant_id, a.table_name, a.feature, a.id, a.x, a.n_y, least(3, a.n_y - 1) AS k, list_sort(list(abs(a.x - b.x)))[least(3, any_value(a.n_y) - 1)] AS r
       FROM mw a JOIN mw b ON a.tenant_id = b.tenant_id AND a.table_name = b.table_name AND a.feature = b.feature AND a.y = b.y AND a.id <> b.id GROUP BY ALL),
mm AS (SELECT r.tenant_id, r.table_name, r.feature, r.id, r.k, r.n_y, count(*) AS m FROM mr r JOIN mw b ON r.tenant_id = b.tenant_id AND r.table_name = b.table_name AND r.feature = b.feature
            AND ((b.x > r.x - r.r AND b.x < r.x + r.r) OR (r.r = 0 AND b.x = r.x)) GROUP BY ALL),
mik AS (SELECT tenant_id, table_name, feature, round(greatest({_digamma_sql("count(*)")} + avg({_digamma_sql("k")} - {_digamma_sql("n_y")} - {_digamma_sql("m")}), 0.0::DOUBLE), 9) AS mi FROM mm GROUP BY ALL)"""


def _mi_sql(kind: str) -> str:
    return SEL_BASE + _mi_ctes(kind == "discrete", kind == "numeric") + """
SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, table_name ORDER BY mi, feature) AS INTEGER) AS mi_rank FROM mi"""


@query("mi_discrete", _mi_sql("discrete"))
def mi_discrete(spark, d):
    """Mutual information of the categorical features with the class, per nation."""
    return sel.mutual_information(selection_input(spark, d), KEYS, "o_orderpriority", categorical=CAT)


@query("mi_numeric", _mi_sql("numeric"))
def mi_numeric(spark, d):
    """Mutual information of the binned numeric features with the class, per nation."""
    return sel.mutual_information(selection_input(spark, d), KEYS, "o_orderpriority", numeric=NUM)


@query("mi_numeric_knn", SEL_BASE + _MI_NEAR + """
SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, table_name ORDER BY mi, feature) AS INTEGER) AS mi_rank FROM mik""")
def mi_numeric_knn(spark, d):
    """Mutual information of the numeric features with the class by nearest neighbours, per nation, all rows."""
    return sel.mutual_information(selection_input(spark, d), KEYS, "o_orderpriority", numeric=NUM, id_col="o_orderkey")


@query("cv_scores", cv_sql(FULL) + " SELECT cv.*, cset.n_features FROM cv JOIN cset USING (cand)")
def cv_scores(spark, d):
    """5-fold CV accuracy of k in {3,5,7,9} x {uniform, distance}, all features."""
    return _cv(spark, d, FULL)


@query("cv_folds", cv_sql(FULL) + " SELECT tenant_id, table_name, cand, k, weights, fold_g AS fold, round(acc, 9) AS fold_accuracy FROM facc")
def cv_folds(spark, d):
    """The accuracy of every fold behind ``cv_scores``."""
    s = selection_sample(spark, d)
    s = materialize(sel.stratified_folds(s, KEYS, "o_orderpriority", "o_orderkey"), "cv_sample")
    cands = _cands_df(s.select(*KEYS).distinct(), FULL)
    f = sel.cv_fold_scores(s, cands, KEYS, id_col="o_orderkey", target="o_orderpriority", numeric=NUM, categorical=CAT)
    return f.select(*KEYS, "cand", "k", "weights", "fold", F.round(F.col("n_correct") / F.col("n_rows"), 9).alias("fold_accuracy"))


@query("cv_candidates", cv_sql(DROP_ONE) + " SELECT cv.*, cset.n_features FROM cv JOIN cset USING (cand)")
def cv_candidates(spark, d):
    """C7 for the full set and every drop-one subset in one neighbour job."""
    return _cv(spark, d, DROP_ONE)


@query("best_minimal", cv_sql(DROP_ONE) + """,
cvn AS (SELECT cv.*, cset.n_features FROM cv JOIN cset USING (cand)),
bst AS (SELECT tenant_id, table_name, max(mean_accuracy) AS b FROM cvn GROUP BY ALL)
SELECT * EXCLUDE (r) FROM (
  SELECT cvn.*, row_number() OVER (PARTITION BY tenant_id, table_name
                                   ORDER BY n_features, mean_accuracy DESC, k, weights, cand) AS r
  FROM cvn JOIN bst USING (tenant_id, table_name) WHERE mean_accuracy >= b - 0.01::DOUBLE) WHERE r = 1""")
def best_minimal(spark, d):
    """Fewest features within 0.01 of the best CV accuracy."""
    return sel.best_minimal(_cv(spark, d, DROP_ONE), KEYS)


@query("cv_confusion", cv_sql(FULL) + """
SELECT tenant_id, table_name, cand, k, weights, fold_g AS fold, truth AS y_true, t_label AS y_pred, count(*) AS n FROM pred GROUP BY ALL""")
def cv_confusion(spark, d):
    """The confusion counts of every fold, k and weighting behind ``cv_scores``."""
    s = materialize(sel.stratified_folds(selection_sample(spark, d), KEYS, "o_orderpriority", "o_orderkey"), "cv_sample")
    cands = _cands_df(s.select(*KEYS).distinct(), FULL)
    return sel.cv_confusion(s, cands, KEYS, id_col="o_orderkey", target="o_orderpriority", numeric=NUM, categorical=CAT)


# --- backward elimination, unrolled: four features, so three rounds at most -----------
_ALL_SUBSETS = {",".join(c): list(c) for n in range(len(FEATS), 0, -1) for c in itertools.combinations(FEATS, n)}


def _round_sql(r: int) -> str:
    """Round r: every drop-one candidate of the groups that go on, the decision, the next state."""
    return f""",
c{r} AS (SELECT st.*, d.feature AS dropped, d.mi_rank, list_filter(st.features, lambda x: x <> d.feature) AS new_features
        FROM state{r - 1} st JOIN mir d ON d.tenant_id = st.tenant_id AND d.table_name = st.table_name AND list_contains(st.features, d.feature)
        WHERE st.active AND len(st.features) > 1),
e{r} AS (SELECT c{r}.*, acc.accuracy, acc.accuracy >= best AS improved FROM c{r} JOIN acc ON acc.tenant_id = c{r}.tenant_id AND acc.table_name = c{r}.table_name AND acc.cand = array_to_string(list_sort(new_features), ',')
        WHERE acc.accuracy >= best - 0.05::DOUBLE),
d{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, table_name ORDER BY improved DESC, CASE WHEN improved THEN mi_rank END, accuracy DESC, mi_rank) AS rn FROM e{r}) WHERE rn = 1),
rounds{r} AS (SELECT st.tenant_id, st.table_name, {r} AS round, d.dropped, d.accuracy, st.best AS best_before, d.mi_rank, d.improved, list_sort(coalesce(d.new_features, st.features)) AS features
             FROM state{r - 1} st LEFT JOIN d{r} d USING (tenant_id, table_name) WHERE st.active AND len(st.features) > 1),
state{r} AS (SELECT st.tenant_id, st.table_name, coalesce(d.new_features, st.features) AS features, greatest(st.best, coalesce(d.accuracy, st.best)) AS best, st.active AND d.tenant_id IS NOT NULL AS active
            FROM state{r - 1} st LEFT JOIN d{r} d USING (tenant_id, table_name))"""


ELIMINATION_SQL = cv_sql(_ALL_SUBSETS) + _mi_ctes(True, False) + _MI_NEAR + f""",
mir AS (SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, table_name ORDER BY mi, feature) AS INTEGER) AS mi_rank FROM (SELECT * FROM mi UNION ALL SELECT * FROM mik)),
acc AS (SELECT tenant_id, table_name, cand, max(mean_accuracy) AS accuracy FROM cv GROUP BY ALL),
state0 AS (SELECT tenant_id, table_name, {FEATS} AS features, accuracy AS best, true AS active FROM acc WHERE cand = '{",".join(FEATS)}')""" + "".join(_round_sql(r) for r in (1, 2, 3))


def _eliminated(spark, d):
    return sel.backward_elimination(selection_input(spark, d), KEYS, id_col="o_orderkey", target="o_orderpriority", numeric=NUM, categorical=CAT, with_rounds=True)


@query("backward_elimination", ELIMINATION_SQL + " SELECT tenant_id, table_name, list_sort(features) AS features, best AS best_accuracy FROM state3")
def backward_elimination(spark, d):
    """Backward elimination per nation; final feature set and best accuracy."""
    return _eliminated(spark, d)[1]


@query("elimination_rounds", ELIMINATION_SQL + " UNION ALL ".join(f" SELECT * REPLACE (array_to_string(features, ',') AS features) FROM rounds{r}" for r in (1, 2, 3)))
def elimination_rounds(spark, d):
    """The decision of every round and nation: feature dropped, accuracy, whether it improved, features left."""
    return _eliminated(spark, d)[2].withColumn("features", F.array_join("features", ","))
