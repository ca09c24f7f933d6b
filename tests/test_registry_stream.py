"""Registry round trip, config resolution, request intake, streaming = batch scoring."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.config import ModelSpec
from ledgerlens.operators import scoring
from ledgerlens.sources import registry as reg
from ledgerlens.sources import requests as rq
from ledgerlens.streaming.score_stream import score_stream


def test_latest_version_and_rewrite(spark):
    path = tempfile.mkdtemp(prefix="ll-reg-") + "/art"
    df = spark.createDataFrame([("7", "t", 1.0), ("8", "t", 2.0)], "tenant_id string, table_name string, v double")
    reg.write_partitioned(df, path, "2024-01-01-00-00-00")
    reg.write_partitioned(df.withColumn("v", F.col("v") * 10), path, "2024-02-01-00-00-00")
    reg.write_partitioned(df.filter("tenant_id = '7'").withColumn("v", F.lit(99.0)), path, "2024-03-01-00-00-00")
    got = {r["tenant_id"]: (r["run_ts"], r["v"]) for r in reg.read_latest(spark, path).collect()}
    assert got == {"7": ("2024-03-01-00-00-00", 99.0), "8": ("2024-02-01-00-00-00", 20.0)}
    # re-running a run replaces only its partitions
    reg.write_partitioned(df.withColumn("v", F.lit(5.0)), path, "2024-02-01-00-00-00")
    got = {r["tenant_id"]: r["v"] for r in reg.read_latest(spark, path).collect()}
    assert got == {"7": 99.0, "8": 5.0}
    assert reg.read_latest(spark, path + "-missing").count() == 0


def test_text_tenant_ids_and_session_setting_survive(spark):
    path = tempfile.mkdtemp(prefix="ll-reg-") + "/art"
    df = spark.createDataFrame([("007", "t", 1.0), ("12e4", "t", 2.0)], "tenant_id string, table_name string, v double")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    reg.write_partitioned(df, path, "2024-01-01-00-00-00")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    assert {r["tenant_id"]: r["v"] for r in reg.read_latest(spark, path).collect()} == {"007": 1.0, "12e4": 2.0}


def test_resolve_config(spark):
    groups = spark.createDataFrame([("1", "a"), ("2", "a"), ("1", "b")], "tenant_id string, table_name string")
    defaults = reg.defaults_frame(spark, [reg.DefaultConfig("a", ("x", "y")), reg.DefaultConfig("b", ("z",), k=5)])
    sel = spark.createDataFrame([("1", "a", ["x"], 3, "uniform")],
                                "tenant_id string, table_name string, features array<string>, k int, weights string")
    got = {(r["tenant_id"], r["table_name"]): (r["features"], r["k"], r["weights"], r["source"])
           for r in reg.resolve_config(groups, defaults, sel).collect()}
    assert got == {("1", "a"): (["x"], 3, "uniform", "selection"),
                   ("2", "a"): (["x", "y"], 7, "distance", "default"),
                   ("1", "b"): (["z"], 5, "distance", "default")}


def test_requests_clean_and_route(spark):
    d = tempfile.mkdtemp(prefix="ll-req-")
    reqs = [{"request_id": "r1", "tenant_id": "t1", "table": "inv",
             "data": [{"code": "NaN", "amount": "12.5"}, {"code": "A", "amount": "abc"}]},
            {"request_id": "r2", "tenant_id": "t9", "table": "inv", "data": [{"code": "B", "amount": "1"}]}]
    with open(os.path.join(d, "r.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in reqs))
    recs = rq.read_requests(spark, d, "code string, amount string")
    recs = rq.clean_request_records(recs, categorical=("code",), numeric=("amount",))
    groups = spark.createDataFrame([("t1", "inv")], "tenant_id string, table_name string")
    ok, rejected = rq.route_known(recs, groups)
    assert {(r["code"], r["amount"]) for r in ok.collect()} == {(None, 12.5), ("A", None)}
    assert [r["tenant_id"] for r in rejected.collect()] == ["t9"]
    assert rq.mixed_kind_requests(recs).count() == 0


def test_stream_equals_batch(spark):
    rows = [("t", "x", i, "A" if i % 3 else "B", float(i % 7), "c" if i % 2 else "d") for i in range(60)]
    df = spark.createDataFrame(rows, "tenant_id string, table_name string, id long, y string, v double, c string")
    spec = ModelSpec(id_col="id", target="y", numeric=("v",), categorical=("c",), k=3)
    model = scoring.fit(df.filter("id >= 20"), spec)
    queries = df.filter("id < 20").drop("y")
    base = tempfile.mkdtemp(prefix="ll-stream-")
    queries.filter("id < 10").write.parquet(base + "/in")
    queries.filter("id >= 10").write.mode("append").parquet(base + "/in")
    q = score_stream(spark, model, base + "/in", queries.schema, base + "/out", base + "/ckpt")
    q.awaitTermination()
    streamed = {r["q_id"]: r["prediction"] for r in spark.read.parquet(base + "/out").collect()}
    _, pred = scoring.predict(model, queries)
    assert streamed == {r["q_id"]: r["prediction"] for r in pred.collect()}


def test_write_artifacts_round_trip(spark):
    base = tempfile.mkdtemp(prefix="ll-art-")
    m = spark.createDataFrame([("t1", "inv", 0.5, None)], "tenant_id string, table_name string, acc double, note string")
    paths = reg.write_artifacts({"metrics": m}, base, "2024-01-01-00-00-00", fmt="json")
    back = spark.read.json(paths["metrics"]).collect()
    assert back[0]["acc"] == 0.5 and back[0]["tenant_id"] == "t1" and "note" in back[0].asDict()
