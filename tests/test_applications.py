"""Line-table applications: masked numerics, audits with failing tables, saved evaluations, class names, text rows, deep pages, sample SQL."""

import datetime as dt
import tempfile

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.config import TAX_TABLES, ModelSpec
from ledgerlens.operators import evaluate as ev
from ledgerlens.operators import knn, scoring
from ledgerlens.operators import selection as sel
from ledgerlens.operators import text as tx
from ledgerlens.plans import q_select
from ledgerlens.sources import registry as reg
from ledgerlens.sources import standins as si
from ledgerlens.sources import tables

KEYS = ["tenant_id", "table_name"]
SPEC = ModelSpec(id_col="id", target="y", numeric=("v", "w"), categorical=("c",), date_col="day", k=3)


def lines(spark, table="t", constant=False):
    rows = [(t, table, i, "XY"[(i * 7 % 10) > 4], 1.0 if constant and t == "A" else float(i % 7), float(i * i % 11), "pq"[i % 2], dt.date(2024, 1, 1 + i % 20))
            for t in "AB" for i in range(40)]
    return spark.createDataFrame(rows, "tenant_id string, table_name string, id long, y string, v double, w double, c string, day date")


def test_a_masked_first_numeric_does_not_order_the_cells(spark):
    """Tenant A has one value of ``v`` and ranks by ``w``; results equal brute force for both tenants."""
    rows = lines(spark, constant=True)
    model = scoring.fit(rows.filter("id >= 10"), SPEC)
    queries = rows.filter("id < 10")
    scales = {r.tenant_id: (r._std0, r._std1) for r in model.stats.collect()}
    data = {(r.tenant_id, r.id): r for r in rows.collect()}
    got = {}
    for r in scoring.neighbors(model, queries).collect():
        got.setdefault((r.tenant_id, r.q_id), []).append((r.rank, r.t_id))
    assert len(got) == 20
    for (t, q), found in got.items():
        a, (s0, s1) = data[t, q], scales[t]
        want = sorted(((a.v - b.v) ** 2 / s0 ** 2 + (a.w - b.w) ** 2 / s1 ** 2 + 2.0 * (a.c != b.c), b.id) for (u, i), b in data.items() if u == t and i >= 10)
        assert [i for _, i in sorted(found)] == [i for _, i in want[:3]]
    values = {(r.tenant_id, r.tn0) for r in model.neighbor_index().rows.select("tenant_id", "tn0").collect()}
    assert len({x for t, x in values if t == "A"}) > 1  # the used feature stands first


def test_masked_numerics_keep_their_scales(spark):
    df = spark.createDataFrame([("A", 5.0, 6.0, None, 10.0, 20.0, 30.0), ("B", 5.0, 6.0, 7.0, 10.0, 20.0, 30.0)], "g string, qn0 double, qn1 double, qn2 double, qs0 double, qs1 double, qs2 double")
    masks = spark.createDataFrame([("A", False, False, True)], "g string, m0 boolean, m1 boolean, m2 boolean")
    got = {r.g: tuple(r)[1:7] for r in knn._masked(df, "q", ["g"], masks, ["m0", "m1", "m2"], [], 3, 0).collect()}
    assert got == {"A": (None, 0.0, 0.0, 30.0, 1.0, 1.0), "B": (5.0, 6.0, 7.0, 10.0, 20.0, 30.0)}


def test_a_failing_table_is_left_out_or_ends_the_audit(spark):
    good, bad = lines(spark), lines(spark, "u").drop("w")
    parts = {n: (SPEC, df.filter("id >= 10"), df.filter("id < 10")) for n, df in (("t", good), ("u", bad))}
    found, failed = scoring.audit_tables(spark, parts, skip_failing=True)
    assert list(failed) == ["u"] and {r.table_name for r in found.select("table_name").distinct().collect()} == {"t"}
    alone = scoring.audit(scoring.fit(good.filter("id >= 10"), SPEC), good.filter("id < 10"))
    assert {(r.tenant_id, r.q_id, r.prediction) for r in found.collect()} == {(r.tenant_id, str(r.q_id), r.prediction) for r in alone.collect()}
    with pytest.raises(PySparkException):
        scoring.audit_tables(spark, parts)
    none, failed = scoring.audit_tables(spark, {"u": parts["u"]}, skip_failing=True)
    assert none.count() == 0 and none.columns == found.columns and list(failed) == ["u"]


def test_table_configs_make_specs():
    assert [c.spec().features for c in TAX_TABLES][0] == ("description", "source_type", "account_name", "item_code", "tax_amount", "line_amount")
    assert all(c.spec().target == "tax_type" and c.spec().k == 7 for c in TAX_TABLES)


def test_evaluations_are_read_back_by_run(spark):
    rows = [("A", "t", 1, "x", "x", 0.9, 0.5, 0.1, 0.2, 0.3), ("A", "t", 2, "x", "z", 0.8, 0.5, 0.1, 0.2, 0.3), ("B", "t", 1, "x", "x", 0.9, 0.5, 0.1, 0.2, 0.3)]
    s = spark.createDataFrame(rows, "tenant_id string, table_name string, q_id long, y_true string, y_pred string, score double, class_frequency double, min_distance double, max_distance double, avg_distance double")
    base, response = tempfile.mkdtemp(prefix="ll-eval-"), s.select(*KEYS, "q_id", F.col("y_pred").alias("prediction"), "score")
    ev.save_evaluation(s, response, KEYS, base, "2024-01-01-00-00-00")
    ev.save_evaluation(s.filter("tenant_id = 'A' and q_id = 1"), response.filter("tenant_id = 'A'"), KEYS, base, "2024-02-01-00-00-00")
    got = ev.load_evaluation(spark, base, KEYS)
    assert set(got) == set(ev.EVALUATION_TABLES)
    assert {(r.tenant_id, r.n, r.accuracy, r.run_ts[:7]) for r in got["evaluation_metrics"].collect()} == {("A", 1, 1.0, "2024-02"), ("B", 1, 1.0, "2024-01")}
    assert {(r.tenant_id, r.y_true, r.y_pred, r.n) for r in ev.load_evaluation(spark, base, KEYS, "2024-01-01-00-00-00")["evaluation_confusion"].collect()} == {
        ("A", "x", "x", 1), ("A", "x", "z", 1), ("A", "z", "x", 0), ("A", "z", "z", 0), ("B", "x", "x", 1)}
    assert got["evaluation_lines"].filter("y_true is not null").count() == 2  # the truth is kept
    empty = ev.load_evaluation(spark, tempfile.mkdtemp(prefix="ll-eval-"), KEYS)
    assert all(df.count() == 0 and {"tenant_id", "run_ts"} <= set(df.columns) for df in empty.values())


def test_class_names_by_tenant_and_code(spark):
    pc = spark.createDataFrame([("A", "200"), ("B", "200"), ("A", "x")], "tenant_id string, class string")
    names = spark.createDataFrame([("A", "200.0", "Sales"), ("A", "200", "Rent"), ("B", "200", None)], "tenant_id string, code string, name string")
    assert {(r.tenant_id, r["class"], r.class_name) for r in ev.with_class_names(pc, names).collect()} == {("A", "200", "Rent"), ("B", "200", None), ("A", "x", None)}


def test_text_rows_keep_what_a_context_needs(spark):
    spec = ModelSpec(id_col="id", target="y", text=("a", "s"), constraints=("s",), date_col="day")
    df = spark.createDataFrame([("A", "t", 1, None, "q", "None", None, "secret"), ("A", "t", 2, "b", None, "200.0", dt.date(2024, 1, 2), "")],
                               "tenant_id string, table_name string, id long, a string, s string, y string, day date, other string")
    got = tx.text_rows(df, spec)
    assert got.columns == [*KEYS, "doc_id", "s", "day", "y", "feature", "text", "is_null"]
    assert sorted((r.doc_id, r.feature, r.text, r.is_null, r.y) for r in got.collect()) == [
        (1, "a", "", True, "NOT_APPLICABLE"), (1, "s", "q", False, "NOT_APPLICABLE"), (2, "a", "b", False, "200"), (2, "s", "", True, "200")]
    context = tx.TextContext(KEYS, None, None, None, got.drop("text", "is_null"))
    nb = spark.createDataFrame([("A", "t", "a", 1, 2), ("A", "t", "a", 1, 9)], "tenant_id string, table_name string, feature string, q_id long, t_id long")
    assert {(r.t_id, r.t_y, r.t_day) for r in tx.with_records(nb, context, ["y", "day"]).collect()} == {(2, "200", dt.date(2024, 1, 2)), (9, None, None)}


def test_deep_pages_by_counts(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id", "id % 7 as g", "cast(id as string) as _before_")
    order = [F.col("g").desc(), "id"]
    want = [[(r.g, r.id) for r in tables.page(df, order, n, 64).collect()] for n in (0, 3, 15, 16)]
    monkeypatch.setattr(tables, "PAGE_ROWS", 0)
    for n, rows in zip((0, 3, 15, 16), want, strict=True):
        p = tables.page(df, order, n, 64)
        assert p.columns == df.columns and [(r.g, r.id) for r in p.collect()] == rows
    assert [len(x) for x in want] == [64, 64, 40, 0]


def test_sample_sql_is_the_sample(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = set(con.execute(q_select.sample_sql(40) + " SELECT tenant_id, id, fold FROM sf").fetchall())
    rows = scoring.fit(si.order_features(spark, sf), q_select.SEL_SPEC).ref
    sample = sel.sample_min_per_class(rows, KEYS, "o_orderpriority", "o_orderkey", num_samples=40)
    got = {(r.tenant_id, r.o_orderkey, r.fold) for r in sel.stratified_folds(sample, KEYS, "o_orderpriority", "o_orderkey").collect()}
    assert got == want and len(want) < rows.count()


def test_selection_runs_resolve_configs(spark):
    """Tenant A has two runs, B one, C none; table u asks for the best-minimal config; without any run all take the defaults."""
    def cv(rows):
        return spark.createDataFrame(rows, "tenant_id string, table_name string, cand string, n_features int, k int, weights string, mean_accuracy double, n_folds long")

    base = tempfile.mkdtemp(prefix="ll-sel-")
    old = cv([("A", "t", "x", 1, 9, "uniform", 0.9, 5), ("B", "t", "x", 1, 5, "uniform", 0.4, 5)])
    new = cv([("A", "t", "x,y", 2, 3, "distance", 0.8, 5), ("A", "t", "x", 1, 5, "uniform", 0.795, 5), ("A", "u", "p,q", 2, 3, "distance", 0.7, 5), ("A", "u", "q", 1, 7, "distance", 0.695, 5)])
    for run_ts, rows in (("2024-01-01-00-00-00", old), ("2024-02-01-00-00-00", new)):
        reg.save_selection(rows, sel.best_minimal(rows, KEYS), base, run_ts)
    groups = spark.createDataFrame([(t, x) for t in "ABC" for x in "tu"], "tenant_id string, table_name string")
    defaults = reg.defaults_frame(spark, [reg.DefaultConfig("t", ("x", "z")), reg.DefaultConfig("u", ("p",), minimal=True)])
    got = {(r.tenant_id, r.table_name): (",".join(r.features), r.k, r.source) for r in reg.saved_config(spark, base, groups, defaults).collect()}
    assert got == {("A", "t"): ("x,y", 3, "selection"), ("A", "u"): ("q", 7, "selection"), ("B", "t"): ("x", 5, "selection"),
                   ("B", "u"): ("p", 7, "default"), ("C", "t"): ("x,z", 7, "default"), ("C", "u"): ("p", 7, "default")}
    report = reg.load_selection(spark, base)["selection_report"].filter("tenant_id = 'A' and table_name = 't'").orderBy("rank").collect()
    assert [r.rank for r in report] == [1, 2] and report[0].line.startswith("1. features=[x,y] k=3") and report[0].run_ts == "2024-02-01-00-00-00"
    none = reg.saved_config(spark, tempfile.mkdtemp(prefix="ll-sel-"), groups, defaults).collect()
    assert len(none) == 6 and {r.source for r in none} == {"default"}


def test_model_cards(spark):
    rows = lines(spark, constant=True).withColumn("y", F.when((F.col("tenant_id") == "A") & (F.col("id") < 3), "Z").otherwise(F.col("y")))
    model = scoring.fit(rows, SPEC)
    got = {r.tenant_id: r for r in scoring.model_card(model).collect()}
    a, b = got["A"], got["B"]
    assert (a.numerical_features, a.constant_columns, a.removed_classes, a.class_counts["Z"], a.num_samples, a.input_dim, a.run_ts) == (["w"], ["v"], ["Z"], 3, 37, 3, None)
    assert (b.numerical_features, b.constant_columns, b.removed_classes, b.num_samples, b.input_dim) == (["v", "w"], [], [], 40, 4)
    assert (a.n_neighbors, a.weights, a.source, a.target_variable, a.categorical_features) == (3, "distance", "spec", "y", ["c"])
    base = tempfile.mkdtemp(prefix="ll-card-")
    scoring.save_model(model, base, "2024-01-01-00-00-00")
    loaded = {r.tenant_id: r for r in scoring.model_card(scoring.load_model(spark, base, SPEC)).collect()}
    assert {r.run_ts for r in loaded.values()} == {"2024-01-01-00-00-00"} and loaded["A"].asDict() | {"run_ts": None} == a.asDict()
