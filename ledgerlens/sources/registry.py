"""Model registry: versioned artefacts as partitioned parquet.

Artefacts of a run live under ``<base>/<artefact>/run_ts=<ts>/table_name=../tenant_id=..``.
"Latest version" is the maximum run timestamp per tenant; listing versions
is partition discovery (``select distinct``), not a storage listing loop.

What several artefacts make up (a model, a text context) is saved by ``save_run``:
every attempt at a run writes below ``attempt=<id>`` of its own, and last the run's
manifest, a row per (tenant, table) with the attempt that counts.  So a run that
broke off is no version, a repeated one replaces the former as a whole, and
``read_run`` picks each tenant's version once, from the manifest, for all artefacts.
A version of a tenant is a run in which at least one of its tables was finished;
tables that the run skipped have no model then.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.config import DEFAULT_K, DEFAULT_WEIGHTS
from ledgerlens.session import materialize

RUN_TS_FORMAT = "yyyy-MM-dd-HH-mm-ss"
PARTITIONS = ("run_ts", "attempt", "table_name", "tenant_id")
MANIFEST = "manifest"
MANIFEST_SCHEMA = "table_name string, tenant_id string, state string, reason string, artefacts array<string>, attempt string, run_ts string"


def write_partitioned(df: DataFrame, path: str, run_ts: str, mode: str = "overwrite", attempt: str | None = None) -> None:
    """Write an artefact for one run, partitioned by run, (attempt,) table, tenant.

    Dynamic partition overwrite replaces only the partitions this run writes,
    so re-running a failed job is idempotent.  Rows are dealt by partition, few files
    each; a large tenant is split over tasks.
    """
    df = df.withColumn("run_ts", F.lit(run_ts))
    if attempt is not None:
        df = df.withColumn("attempt", F.lit(attempt))
    cols = [c for c in PARTITIONS if c in df.columns]
    (df.hint("rebalance", *[F.col(c) for c in cols])
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path))


def save_run(frames: dict[str, DataFrame], groups: DataFrame, base: str, run_ts: str) -> str:
    """Writes the artefacts of one run, then its manifest; returns the attempt.

    ``groups``: table_name, tenant_id and, if tables can be skipped, state and reason.
    """
    attempt, base = uuid.uuid4().hex, base.rstrip("/")
    for name, df in frames.items():
        write_partitioned(df, f"{base}/{name}", run_ts, attempt=attempt)
    state = F.col("state") if "state" in groups.columns else F.lit("FINISHED")
    reason = F.col("reason") if "reason" in groups.columns else F.lit(None)
    rows = groups.select("table_name", "tenant_id", state.alias("state"), reason.cast("string").alias("reason")).distinct()
    rows = rows.withColumn("artefacts", F.array(*[F.lit(n) for n in frames])).withColumn("attempt", F.lit(attempt))
    rows.write.mode("overwrite").parquet(f"{base}/{MANIFEST}/run_ts={run_ts}")
    return attempt


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """A row per committed (run, tenant, table); empty where nothing was saved."""
    schema = spark.createDataFrame([], MANIFEST_SCHEMA).schema
    return read_artefact(spark, f"{base.rstrip('/')}/{MANIFEST}", schema)


def chosen_runs(runs: DataFrame, version: str | None = None) -> DataFrame:
    """tenant_id, run_ts, attempt: each tenant's latest (or the given) version, by its manifest rows."""
    done = runs.filter("state = 'FINISHED'")
    if version is not None:
        done = done.filter(F.col("run_ts") == F.lit(version))
    last = F.max(F.struct(run_time().alias("at"), "run_ts", "attempt")).alias("_v")
    return done.groupBy("tenant_id").agg(last).select("tenant_id", "_v.run_ts", "_v.attempt")


def missing_version(runs: DataFrame, version: str) -> DataFrame:
    """Tenants that have versions but not this one, with their latest."""
    return chosen_runs(runs).join(chosen_runs(runs, version).select("tenant_id"), "tenant_id", "left_anti").select("tenant_id", F.col("run_ts").alias("latest"))


def group_versions(runs: DataFrame, version: str | None = None) -> DataFrame:
    """C20: what a tenant's table is served with: tenant_id, table_name, run_ts, state, reason of the chosen runs."""
    return runs.join(chosen_runs(runs, version), ["tenant_id", "run_ts", "attempt"]).select("tenant_id", "table_name", "run_ts", "state", "reason")


def read_run(spark: SparkSession, base: str, schemas: dict[str, T.StructType | None], version: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(chosen runs, artefacts by name), all artefacts of a tenant from one run.

    The choice is written down once, so a run committed meanwhile does not mix in.  An artefact
    that was never written is empty, with the columns of its schema.
    """
    chosen = materialize(chosen_runs(manifest(spark, base), version), "chosen_runs")
    out = {}
    for name, schema in schemas.items():
        art = read_artefact(spark, f"{base.rstrip('/')}/{name}", schema)
        for c in ("run_ts", "attempt", "tenant_id"):
            if c not in art.columns:
                art = art.withColumn(c, F.lit(None).cast("string"))
        out[name] = art.join(chosen, ["tenant_id", "run_ts", "attempt"], "left_semi").drop("run_ts", "attempt")
    return chosen, out


def run_time(col: str = "run_ts"):
    """Parse a run timestamp text ``yyyy-MM-dd-HH-mm-ss``."""
    return F.to_timestamp(F.col(col), RUN_TS_FORMAT)


def latest_version(runs: DataFrame, keys=("tenant_id",), ts_col: str = "run_ts") -> DataFrame:
    """The latest run per tenant (max parsed timestamp; text as tie-break)."""
    w = Window.partitionBy(*keys).orderBy(run_time(ts_col).desc(), F.col(ts_col).desc())
    return (runs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
                .withColumn("run_time", run_time(ts_col)))


def list_versions(artefact: DataFrame, keys=("tenant_id",)) -> DataFrame:
    """Distinct run timestamps per tenant of a partitioned artefact."""
    return artefact.select(*keys, "run_ts").distinct()


def read_artefact(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All runs of an artefact; partition values as the text that was written ('007' stays '007').

    A missing path gives an empty frame (of ``schema``, or of the partition columns); else
    the files' own columns count.
    """
    try:
        found = spark.read.parquet(path).schema
        found = T.StructType([T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in found.fields])
        return spark.read.schema(found).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing there, or a folder without files
            raise
    return spark.createDataFrame([], schema or T.StructType([T.StructField(c, T.StringType()) for c in PARTITIONS]))


def read_latest(spark: SparkSession, path: str, keys=("tenant_id",), version: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """An artefact restricted to the latest (or a given) run of each tenant.

    A missing artefact yields an empty result (of ``schema``, which names the partition columns too), not an error (S19).
    """
    art = read_artefact(spark, path, schema)
    if version is not None:
        return art.filter(F.col("run_ts") == F.lit(version))
    latest = latest_version(list_versions(art, keys), keys).select(*keys, "run_ts")
    return art.join(latest, list(keys) + ["run_ts"], "left_semi")


@dataclass(frozen=True)
class DefaultConfig:
    table_name: str
    features: tuple[str, ...]
    k: int = DEFAULT_K
    weights: str = DEFAULT_WEIGHTS
    minimal: bool = False  # of a selection run, take the config of fewest features near the best


def defaults_frame(spark: SparkSession, defaults: list[DefaultConfig]) -> DataFrame:
    return spark.createDataFrame(
        [(d.table_name, list(d.features), d.k, d.weights, d.minimal) for d in defaults],
        "table_name string, default_features array<string>, default_k int, default_weights string, load_minimal boolean")


def selected_config(best: DataFrame, minimal: DataFrame, defaults: DataFrame, keys=("tenant_id", "table_name")) -> DataFrame:
    """The config of a selection run that a table asks for: the best, or the best-minimal one (``minimal`` flag).

    ``best``, ``minimal``: one row per group with cand, k, weights (``rank_one``, ``selection.best_minimal``).
    """
    flag = defaults.select("table_name", F.coalesce("load_minimal", F.lit(False)).alias("_minimal"))
    cols = [*keys, F.split("cand", ",").alias("features"), "k", "weights"]
    one = best.join(flag, "table_name", "left").filter(~F.coalesce("_minimal", F.lit(False)))
    few = minimal.join(flag, "table_name").filter("_minimal")
    return one.select(*cols).unionByName(few.select(*cols))


def resolve_config(groups: DataFrame, defaults: DataFrame, selected: DataFrame | None,
                   keys=("tenant_id", "table_name")) -> DataFrame:
    """Per (tenant, table) the selected features/k/weights, else the table's defaults.

    ``selected``: ``(keys, features, k, weights)`` from a selection run (one
    row per group: rank-1 or best-minimal, chosen by the caller).
    """
    keys = list(keys)
    g = groups.select(*keys).distinct().join(defaults, "table_name", "left")
    if selected is not None:
        s = selected.select(*keys, F.col("features").alias("_sf"), F.col("k").alias("_sk"),
                            F.col("weights").alias("_sw"))
        g = g.join(s, keys, "left")
    else:
        g = g.select("*", F.lit(None).cast("array<string>").alias("_sf"), F.lit(None).cast("int").alias("_sk"),
                     F.lit(None).cast("string").alias("_sw"))
    return g.select(*keys,
                    F.coalesce("_sf", "default_features").alias("features"),
                    F.coalesce(F.col("_sk").cast("int"), "default_k").alias("k"),
                    F.coalesce("_sw", "default_weights").alias("weights"),
                    F.when(F.col("_sf").isNotNull(), F.lit("selection")).otherwise(F.lit("default")).alias("source"))


def rank_one(cv: DataFrame, keys=("tenant_id", "table_name")) -> DataFrame:
    """The best config per group (highest mean accuracy; ties: fewer features, k, weights)."""
    w = Window.partitionBy(*keys).orderBy(F.col("mean_accuracy").desc(), "n_features", "k", "weights", "cand")
    return cv.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def report_lines(cv: DataFrame, keys=("tenant_id", "table_name")) -> DataFrame:
    """Ranked text report, one formatted line per config."""
    w = Window.partitionBy(*keys).orderBy(F.col("mean_accuracy").desc(), "n_features", "k", "weights", "cand")
    return cv.withColumn("rank", F.row_number().over(w)).select(
        *keys, "rank", F.format_string("%d. features=[%s] k=%d weights=%s mean_accuracy=%.4f folds=%d",
                                       F.col("rank"), F.col("cand"), F.col("k"), F.col("weights"),
                                       F.col("mean_accuracy"), F.col("n_folds")).alias("line"))


#: Artefacts of a selection run (S13) and their columns besides the group's.
_RESULT = "cand string, n_features int, k int, weights string, mean_accuracy double, n_folds long"
SELECTION_TABLES = {"selection_results": _RESULT, "selection_report": "rank int, line string", "selection_minimal": _RESULT}


def save_selection(cv: DataFrame, minimal: DataFrame, base: str, run_ts: str, keys=("tenant_id", "table_name")) -> None:
    """Writes one selection run: the results of all configs, the ranked text report and the best-minimal config; the manifest last.

    ``minimal``: one row per group with the columns of ``cv`` (``selection.best_minimal``).
    """
    frames = (cv, report_lines(cv, keys), minimal.select(*cv.columns))
    save_run(dict(zip(SELECTION_TABLES, frames, strict=True)), cv.select("table_name", "tenant_id").distinct(), base, run_ts)


def load_selection(spark: SparkSession, base: str, keys=("tenant_id", "table_name"), version: str | None = None) -> dict[str, DataFrame]:
    """The artefacts of every tenant's latest (or a given) selection run, with ``run_ts``; empty where none was saved."""
    schemas = {name: T.StructType.fromDDL(", ".join(f"{k} string" for k in keys) + ", " + cols) for name, cols in SELECTION_TABLES.items()}
    runs, art = read_run(spark, base, schemas, version)
    return {name: df.join(runs.select("tenant_id", "run_ts"), "tenant_id") for name, df in art.items()}


def saved_config(spark: SparkSession, base: str, groups: DataFrame, defaults: DataFrame, keys=("tenant_id", "table_name"), version: str | None = None) -> DataFrame:
    """Per group the config of its tenant's latest selection run (best or best-minimal, as its table asks), else the table's defaults."""
    art = load_selection(spark, base, keys, version)
    chosen = selected_config(rank_one(art["selection_results"], keys), art["selection_minimal"], defaults, keys)
    return resolve_config(groups, defaults, chosen, keys)


def write_artifacts(frames: dict[str, DataFrame], base: str, run_ts: str, fmt: str = "json") -> dict[str, str]:
    """Write named result tables of one run (``json``, ``csv`` or ``parquet``).

    Each table lands in ``<base>/<name>/run_ts=<ts>/`` partitioned like the
    model artefacts (table, tenant) when it has those columns; csv keeps a
    header (and, unlike the reference, every column including the truth).
    Returns the written paths.
    """
    out = {}
    for name, df in frames.items():
        path = f"{base.rstrip('/')}/{name}/run_ts={run_ts}"
        parts = [c for c in ("table_name", "tenant_id") if c in df.columns]
        w = df.write.mode("overwrite")
        if parts:
            w = w.partitionBy(*parts)
        if fmt == "csv":
            w.option("header", "true").csv(path)
        elif fmt == "json":
            w.option("ignoreNullFields", "false").json(path)
        else:
            w.parquet(path)
        out[name] = path
    return out
