"""Evaluation metrics, temporal neighbours, sampling and folds on small fixtures."""

import datetime as dt
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as ev
from ledgerlens.operators import selection as sel
from ledgerlens.operators import temporal


def manual_metrics(y_true, y_pred):
    labels = sorted(set(y_true) | set(y_pred))
    n = len(y_true)
    sup = Counter(y_true)
    pred = Counter(y_pred)
    tp = Counter(t for t, p in zip(y_true, y_pred) if t == p)
    prec = {c: (tp[c] / pred[c] if pred[c] else 0.0) for c in labels}
    rec = {c: (tp[c] / sup[c] if sup[c] else 0.0) for c in labels}
    f1 = {c: (2 * prec[c] * rec[c] / (prec[c] + rec[c]) if prec[c] + rec[c] else 0.0) for c in labels}
    truth = [c for c in labels if sup[c]]
    c = sum(tp.values())
    cov = c * n - sum(pred[k] * sup[k] for k in labels)
    den = (n * n - sum(pred[k] ** 2 for k in labels)) * (n * n - sum(sup[k] ** 2 for k in labels))
    return {
        "accuracy": round(c / n, 4),
        "balanced_accuracy": round(sum(rec[k] for k in truth) / len(truth), 4),
        "precision_weighted": round(sum(sup[k] * prec[k] for k in truth) / n, 4),
        "recall_weighted": round(sum(sup[k] * rec[k] for k in truth) / n, 4),
        "f1_weighted": round(sum(sup[k] * f1[k] for k in truth) / n, 4),
        "mcc": round(cov / math.sqrt(den), 4) if den else 0.0,
    }


def test_metrics_multiclass_and_binary(spark):
    rnd = random.Random(1)
    cases = {
        "multi": ([rnd.choice("ABC") for _ in range(50)], None),
        "binary": ([rnd.choice("XY") for _ in range(40)], None),
        "single": (["S"] * 10, None),
    }
    rows = []
    expected = {}
    for g, (yt, _) in cases.items():
        yp = [t if rnd.random() < 0.6 else rnd.choice("ABCXYZ") for t in yt]  # Z: predicted, never true
        rows += [(g, i, t, p) for i, (t, p) in enumerate(zip(yt, yp))]
        expected[g] = manual_metrics(yt, yp)
    df = spark.createDataFrame(rows, "g string, q_id long, y_true string, y_pred string")
    conf = ev.confusion_long(df, ["g"])
    assert conf.groupBy("g").agg(F.sum("n")).count() == 3
    got = {r["g"]: r for r in ev.eval_metrics(conf, ["g"]).collect()}
    for g, exp in expected.items():
        for key, val in exp.items():
            assert abs(got[g][key] - val) < 1e-9, (g, key)
        n_true = len(set(r[2] for r in rows if r[0] == g))
        assert got[g]["recommended_metric"] == ("Matthews Correlation" if n_true == 2 else "F1-Score (Weighted)")


def test_temporal_topk_matches_brute_force(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [("u", i, base + dt.timedelta(hours=rnd.randint(0, 24 * 40))) for i in range(120)]
    df = spark.createDataFrame(rows, "tenant_id string, id long, ts timestamp")
    got = {}
    for r in temporal.temporal_topk(df, df, ["tenant_id"], q_id="id", t_id="id", q_date="ts",
                                    t_date="ts", k=5).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["t_id"]
    for _, qid, qts in rows:
        cand = sorted((abs((t.date() - qts.date()).days), tid) for _, tid, t in rows)
        assert [got[qid][i] for i in range(1, 6)] == [t for _, t in cand[:5]]


def test_sample_and_folds(spark):
    rows = [("g", i, "rare" if i < 3 else ("mid" if i < 40 else "big")) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, y string")
    s = sel.sample_min_per_class(df, ["g"], "y", "id", num_samples=100, min_per_class=5).collect()
    assert len(s) == 100
    c = Counter(r["y"] for r in s)
    assert c["rare"] == 3 and c["mid"] >= 5
    f = sel.stratified_folds(df, ["g"], "y", "id", folds=5).collect()
    per = Counter((r["y"], r["fold"]) for r in f)
    for y in ("rare", "mid", "big"):
        sizes = [per[(y, k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_backward_elimination_keeps_the_informative_feature(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(160):
        x = rnd.uniform(0, 10)
        rows.append(("g", "t", i, "lo" if x < 5 else "hi", x, rnd.uniform(0, 10), rnd.choice("pqrs")))
    df = spark.createDataFrame(rows, "tenant_id string, table_name string, id long, y string, x double, "
                                     "noise double, tag string")
    cv, state = sel.backward_elimination(df, ["tenant_id", "table_name"], id_col="id", target="y",
                                         numeric=("noise", "x"), categorical=("tag",))
    st = state.collect()[0]
    assert st["features"] == ["x"]
    assert st["best_accuracy"] >= 0.9
    assert cv.filter(F.col("cand") == "noise,tag,x").count() == 8      # full set: 4 k x 2 weightings
