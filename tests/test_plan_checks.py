"""Checks that fail the job or quarantine; temporal neighbours on timestamps; first lines per tenant."""

import datetime as dt
import json
import random
import tempfile

import pytest

from ledgerlens.operators import evaluate as ev
from ledgerlens.operators import selection as sel
from ledgerlens.operators import temporal
from ledgerlens.sources import line_tables as lt
from ledgerlens.sources import requests as rq


def test_two_truth_rows_fail_the_job(spark):
    pred = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b")], "tenant_id string, q_id long, prediction string")
    truth = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 2, "c")], "tenant_id string, id long, correct_target_variable string")
    with pytest.raises(Exception, match="several truth rows of id 2"):
        ev.eval_join(pred, truth, ["tenant_id"]).collect()
    left = ev.eval_join(pred, truth, ["tenant_id"], strict=False).collect()
    assert [(r.q_id, r.y_true) for r in left] == [(1, "a")]
    assert [(r.id, r.n) for r in ev.duplicate_truth(truth, ["tenant_id"]).collect()] == [(2, 2)]
    assert ev.eval_join(pred, truth.filter("id = 1"), ["tenant_id"]).count() == 1


def test_must_have_features(spark):
    df = spark.createDataFrame([("t", "g", 1, "y", 1.0)], "tenant_id string, table_name string, id long, y string, v double")
    with pytest.raises(ValueError, match="must-have features not found: \\['w'\\]"):
        sel.backward_elimination(df, ["tenant_id", "table_name"], id_col="id", target="y", numeric=("v",), must_have=("w",))


def test_requests_of_mixed_kinds(spark):
    folder = tempfile.mkdtemp(prefix="ll-req-")
    bad = [{"request_id": "r2", "tenant_id": "t", "table": "a", "data": [{"x": "1"}, {"y": "2"}]}, {"request_id": "r3", "tenant_id": "t", "table": "a", "data": [{"y": "2"}]}]
    good = [{"request_id": "r1", "tenant_id": "t", "table": "a", "data": [{"x": "1"}, {"x": "2"}]}, {"request_id": "r4", "tenant_id": "t", "table": "b", "data": []}]
    with open(f"{folder}/r.json", "w") as f:
        f.write("\n".join([*map(json.dumps, good + bad), '{"request_id": "r5", "da']))
    kinds = {"a": ("x",), "b": ("y",)}
    ok, refused = rq.read_checked_requests(spark, folder, "x string, y string", kinds, strict=False)
    assert sorted((r.request_id, r.x or "") for r in ok.collect()) == [("r1", "1"), ("r1", "2"), ("r4", "")]
    assert sorted((r.reason, r.request_id or "") for r in refused.collect())[1:] == [("mixed_kinds", "r2"), ("wrong_kind", "r3")]
    with pytest.raises(Exception, match="mixed_kinds|wrong_kind|malformed"):
        rq.read_checked_requests(spark, folder, "x string, y string", kinds)[0].collect()


def test_temporal_on_timestamps(spark):
    rng, zero = random.Random(2), dt.datetime(2024, 1, 1)
    hot = [("h", i, zero + dt.timedelta(days=3, seconds=rng.randrange(86400))) for i in rng.sample(range(10_000), 700)]  # one day holds most rows
    some = [(g, 20_000 + i, zero + dt.timedelta(seconds=rng.choice([0, 43200, 86400, 86399, rng.randrange(900_000)]))) for g in "hx" for i in range(60)]
    rows = hot + some + [("x", 1, None), ("y", 5, zero), ("y", 6, zero - dt.timedelta(microseconds=1)), ("y", 7, zero + dt.timedelta(hours=12))]
    df = spark.createDataFrame(rows, "g string, id long, ts timestamp")
    queries = [r for r in rows if r[2] is not None and (r[1] % 9 == 0 or r[0] == "y")]
    for k in (1, 7):
        got = {}
        for r in temporal.temporal_topk_ts(spark.createDataFrame(queries, "g string, id long, ts timestamp"), df, ["g"], q_id="id", t_id="id", q_time="ts", t_time="ts", k=k).collect():
            got.setdefault((r.g, r.q_id), []).append((r["rank"], r.days, r.t_id))
        for g, i, at in queries:
            want = sorted((abs((t - at).days), j) for h, j, t in rows if h == g and t is not None)[:k]
            assert sorted(got[g, i]) == [(n + 1, *w) for n, w in enumerate(want)], (g, i)
    assert temporal.temporal_topk_ts(df.limit(0), df, ["g"], q_id="id", t_id="id", q_time="ts", t_time="ts").count() == 0


def test_header_ids_are_a_tenants_own(spark):
    plan = lt.LinePlan(table_name="t", header_key="id", line_fk="hid", header_id="hname", line_order=("line_id",), date_col="date", header_cols=("hname",), line_cols=("line_id", "account_code"))
    headers = spark.createDataFrame([(1, "X", "t1", dt.date(2024, 1, 1)), (2, "X", "t2", dt.date(2024, 1, 1))], "id long, hname string, tenant_id string, date date")
    lines = spark.createDataFrame([(1, "X", 10, "1"), (1, "X", 11, "1"), (2, "X", 20, "2")], "hid long, hname string, line_id long, account_code string")
    assert sorted((r.tenant_id, r.line_id) for r in lt.build_lines(headers, lines, None, plan).collect()) == [("t1", 10), ("t2", 20)]
