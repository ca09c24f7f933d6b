"""Registry runs: one version per tenant for all artefacts, skipped and broken runs, no mixing of tenants; configs per group."""

import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import ModelSpec
from ledgerlens.operators import knn, scoring
from ledgerlens.operators import text as tx
from ledgerlens.sources import registry as reg
from ledgerlens.streaming.score_stream import ServedModel, score_stream

KEYS = ["tenant_id", "table_name"]
SPEC = ModelSpec(id_col="id", target="y", numeric=("v", "w"), categorical=("c", "d"), k=3)
RUNS = ("2024-01-01-00-00-00", "2024-02-01-00-00-00", "2024-03-01-00-00-00")


def lines(spark, tenants="AB", n=60, label=lambda i: "XYZ"[i % 3]):
    rows = [(t, "t", i, label(i), float(i % 7), float(i * i % 11), "pq"[i % 2], "rst"[i % 3]) for t in tenants for i in range(n)]
    return spark.createDataFrame(rows, "tenant_id string, table_name string, id long, y string, v double, w double, c string, d string")


def answers(model, queries):
    return {(r.tenant_id, r.q_id): (r.prediction, round(r.score, 6)) for r in scoring.predict(model, queries)[1].collect()}


def test_a_reloaded_model_is_the_saved_one(spark):
    base = tempfile.mkdtemp(prefix="ll-run-")
    model, queries = scoring.fit(lines(spark).filter("id >= 20"), SPEC), lines(spark).filter("id < 20").drop("y")
    scoring.save_model(model, base, RUNS[0])
    loaded = scoring.load_model(spark, base, SPEC)
    assert loaded.index is not None and answers(loaded, queries) == answers(model, queries)
    assert scoring.train_summary(loaded).count() == 2


def test_skipped_and_broken_runs_do_not_mix(spark):
    base = tempfile.mkdtemp(prefix="ll-run-")
    queries = lines(spark).filter("id < 20").drop("y")
    first = scoring.fit(lines(spark).filter("id >= 20"), SPEC)
    scoring.save_model(first, base, RUNS[0])
    one_class = F.when(F.col("tenant_id") == "A", F.lit("X")).otherwise(F.col("y"))
    second = scoring.fit(lines(spark).filter("id >= 30").withColumn("y", one_class), SPEC)
    scoring.save_model(second, base, RUNS[1])
    # A was skipped in run 2: its version stays run 1, in all artefacts; B is at run 2
    loaded = scoring.load_model(spark, base, SPEC)
    got, a, b = answers(loaded, queries), answers(first, queries), answers(second, queries)
    assert got == {k: (a if k[0] == "A" else b)[k] for k in got} and {k[0] for k in got} == {"A", "B"}
    assert scoring.rejected(loaded, queries).count() == 0
    served = {r.tenant_id: r.run_ts for r in reg.group_versions(reg.manifest(spark, base)).collect()}
    assert served == {"A": RUNS[0], "B": RUNS[1]}
    assert [(r.tenant_id, r.latest) for r in reg.missing_version(reg.manifest(spark, base), RUNS[1]).collect()] == [("A", RUNS[0])]
    # a run without a manifest is none; a repeated run replaces the former one whole
    reg.write_partitioned(first.ref.limit(3), f"{base}/model_lines", RUNS[2], attempt="broken")
    assert answers(scoring.load_model(spark, base, SPEC), queries) == got
    scoring.save_model(scoring.fit(lines(spark, "B").filter("id >= 30"), SPEC), base, RUNS[1])
    again = scoring.load_model(spark, base, SPEC)
    assert again.ref.filter("tenant_id = 'B'").count() == 30 and answers(again, queries) == got
    assert answers(scoring.load_model(spark, base, SPEC, version=RUNS[0]), queries) == a


def test_a_table_skipped_in_the_tenants_run_is_rejected(spark):
    base = tempfile.mkdtemp(prefix="ll-run-")
    other = lines(spark, "A").withColumn("table_name", F.lit("u"))
    scoring.save_model(scoring.fit(lines(spark, "A").unionByName(other), SPEC), base, RUNS[0])
    scoring.save_model(scoring.fit(lines(spark, "A").unionByName(other.withColumn("y", F.lit("X"))), SPEC), base, RUNS[1])
    model = scoring.load_model(spark, base, SPEC)
    queries = lines(spark, "A", 5).unionByName(other.filter("id < 5")).drop("y")
    assert {(r.table_name, r.reason) for r in scoring.rejected(model, queries).collect()} == {("u", "constant_target")}
    assert {r.table_name for r in scoring.predict(model, queries)[1].collect()} == {"t"}


def test_nothing_saved_gives_a_model_of_no_group(spark):
    model = scoring.load_model(spark, tempfile.mkdtemp(prefix="ll-run-") + "/none", SPEC)
    queries = lines(spark, "A", 4).drop("y")
    assert scoring.predict(model, queries)[1].count() == 0
    assert {r.reason for r in scoring.rejected(model, queries).collect()} == {"no_model"}
    assert tx.load_text(spark, tempfile.mkdtemp(prefix="ll-run-"), KEYS).docs.count() == 0


def text_rows(spark, tenant, n):
    words = ["paper towel", "paper plate", "printer ink", "red ink", "office chair", "desk chair"]
    return spark.createDataFrame([(tenant, "t", "text", f"{tenant}{i}", words[i % 6] + f" {i % 4}", False) for i in range(n)],
                                 "tenant_id string, table_name string, feature string, doc_id string, text string, is_null boolean")


def test_text_contexts_of_different_runs_stay_apart(spark):
    base = tempfile.mkdtemp(prefix="ll-run-")
    tx.save_text(tx.fit_text(text_rows(spark, "A", 9), KEYS), base, RUNS[0])
    tx.save_text(tx.fit_text(text_rows(spark, "B", 7), KEYS), base, RUNS[0])
    tx.save_text(tx.fit_text(text_rows(spark, "B", 6), KEYS), base, RUNS[1])
    c = tx.load_text(spark, base, KEYS)
    got = tx.cosine_topk_tiled(c.weights, c.groups, c.docs, KEYS, k=2).collect()
    assert {(r.tenant_id, r.q_id[0], r.t_id[0]) for r in got} == {("B", "B", "B")} or {(r.tenant_id, r.q_id[0], r.t_id[0]) for r in got} == {("A", "A", "A"), ("B", "B", "B")}
    assert sum(r.tenant_id == "B" for r in got) == 12


def test_configs_of_groups_in_one_job(spark):
    df, queries = lines(spark, "ABCDE").filter("id >= 15"), lines(spark, "ABCDE").filter("id < 15")
    config = spark.createDataFrame([("A", "t", ["v", "c"], 5, "uniform"), ("B", "t", ["w"], 1, "distance"), ("C", "t", ["d"], 7, "distance"), ("D", "t", ["unknown"], 3, "uniform")],
                                   "tenant_id string, table_name string, features array<string>, k int, weights string")
    model = scoring.fit(df, SPEC, config=config)
    nb, pred = scoring.predict(model, queries)
    got = {(r.tenant_id, r.q_id): (r.prediction, round(r.score, 6)) for r in pred.collect()}
    size = {r["tenant_id"]: r["n"] for r in nb.groupBy("tenant_id").agg(F.max("rank").alias("n")).collect()}
    assert size == {"A": 5, "B": 1, "C": 7, "E": 3}
    assert {(r.tenant_id, r.reason) for r in scoring.rejected(model, queries).collect()} == {("D", "no_features")}
    for tenant, features, k, weights in (("A", ("v", "c"), 5, "uniform"), ("B", ("w",), 1, "distance"), ("C", ("d",), 7, "distance"), ("E", ("v", "w", "c", "d"), 3, "distance")):
        alone = ModelSpec(id_col="id", target="y", numeric=tuple(f for f in features if f in "vw"), categorical=tuple(f for f in features if f in "cd"), k=k, weights=weights)
        only = F.col("tenant_id") == tenant
        want = answers(scoring.fit(df.filter(only), alone), queries.filter(only))
        assert {x: y for x, y in got.items() if x[0] == tenant} == want, tenant
    base = tempfile.mkdtemp(prefix="ll-run-")
    scoring.save_model(model, base, RUNS[0])
    assert answers(scoring.load_model(spark, base, SPEC), queries) == got


def test_unknown_weighting_fails_the_job(spark):
    nb = spark.createDataFrame([("g", 1, "a", 1.0)], "g string, q_id long, t_label string, d2 double")
    with pytest.raises(Exception, match="unknown weights"):
        knn.vote(nb, ["g"], spark.createDataFrame([("g", "cubic")], "g string, weights string")).collect()


def test_index_is_probed_not_sorted_again(spark):
    model = scoring.fit(lines(spark).filter("id >= 20"), SPEC.with_(numeric=("v",)))
    model.neighbor_index()
    files = scoring.neighbors(model, lines(spark).filter("id < 20")).inputFiles()
    assert any("knn_index" in f for f in files) and not any("model_ref" in f or "knn_ranges" in f for f in files)


def test_stream_serves_the_current_version(spark):
    base, folder = tempfile.mkdtemp(prefix="ll-run-"), tempfile.mkdtemp(prefix="ll-refresh-")
    queries = lines(spark, "ABZ").drop("y")
    served = ServedModel(base, SPEC)
    want = {}
    for run, tenants, part in ((RUNS[0], "A", "id < 10"), (RUNS[1], "AB", "id >= 10 AND id < 20")):
        model = scoring.fit(lines(spark, tenants).filter("id >= 20"), SPEC)
        scoring.save_model(model, base, run)
        queries.filter(part).write.mode("append").parquet(folder + "/in")
        score_stream(spark, served, folder + "/in", queries.schema, folder + "/out", folder + "/ckpt", with_rejected=True).awaitTermination()
        want |= {k: (*v[:1], None, run) for k, v in answers(model, queries.filter(part)).items()}
        want |= {(r.tenant_id, r.q_id): (None, "no_model", None) for r in scoring.rejected(model, queries.filter(part)).collect()}
    got = {(r.tenant_id, r.q_id): (r.prediction, r.reason, r.run_ts) for r in spark.read.parquet(folder + "/out").collect()}
    assert got == want and len(got) == 60
    # a replay of lines within the watermark adds nothing
    stamped = queries.filter("id < 6").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    for _ in range(2):
        stamped.write.mode("append").parquet(folder + "/in2")
    score_stream(spark, scoring.load_model(spark, base, SPEC), folder + "/in2", stamped.schema, folder + "/out2", folder + "/ckpt2", dedupe_col="id", event_time="at").awaitTermination()
    assert spark.read.parquet(folder + "/out2").count() == 6
