"""Fit and score kNN models for all groups at once.

``fit`` turns cleaned training lines into the model tables (reference rows,
class counts, numeric stats, per-group feature mask); ``score`` returns the
neighbours (explanations) and the vote for every query line.  Neighbours are
computed once and both the vote and the explanations derive from them.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.config import ModelSpec
from ledgerlens.functions.labels import clean_target, float_string_label
from ledgerlens.operators import features as fe
from ledgerlens.operators import knn
from ledgerlens.operators import profile
from ledgerlens.session import discard, materialize, side_by_side
from ledgerlens.sources import registry
from ledgerlens.sources.tables import date_range


@dataclass
class Model:
    """Fitted state of every group: all DataFrames, nothing on the driver."""

    spec: ModelSpec
    ref: DataFrame          # cleaned, rare classes removed
    counts: DataFrame       # (keys, class, n) before rare-class removal
    kept: DataFrame         # counts + kept flag
    stats: DataFrame        # one row per trained group: _mean{i}, _std{i}
    mask: DataFrame         # one row per trained group: use_<feature> booleans
    state: DataFrame        # one row per group of the input: n_rows, n_classes, reason, state (P15)
    values: DataFrame       # (keys, feature, value) of the categorical features of trained groups
    choice: DataFrame       # one row per trained group: features, k, weights, source (S20, or the spec's own)
    most_k: int             # largest k of all groups
    index: knn.Index | None = field(default=None, repr=False)
    runs: DataFrame | None = None  # of a loaded model: tenant_id, run_ts, attempt that it was read from

    def neighbor_index(self, k: int = 0) -> knn.Index:
        """The references by cell and position; built at the first use, or loaded (again for a larger ``k``)."""
        keep = max(k, self.most_k) + 1
        if self.index is None or self.index.keep < keep:
            self.index = self._built(keep=keep)
        if self.index.more is None:  # a loaded index
            self.index.more = lambda subsets, cells: self._built(keep=self.index.keep, subsets=subsets, only=cells)
        return self.index

    def _built(self, **how) -> knn.Index:
        rows = fe.with_scale(self.ref, self.stats, list(self.spec.group_keys), self.spec.numeric)
        return knn.build_index(rows, t_id=self.spec.id_col, t_label=self.spec.target, **how, **self.columns())

    def columns(self) -> dict:
        """Feature columns for the kNN join."""
        spec = self.spec
        return {"keys": list(spec.group_keys), "num": [f"x_{c}" for c in spec.numeric], "cat": list(spec.categorical), "masks": self.mask,
                "num_mask": [f"use_{c}" for c in spec.numeric], "cat_mask": [f"use_{c}" for c in spec.categorical]}


def feature_mask(ref: DataFrame, keys, features) -> DataFrame:
    """P10 per group: a feature is used unless constant (null counts as a value)."""
    # two different values, or a value and a null; min and max aggregate map-side
    aggs = [F.coalesce((F.min(c) != F.max(c)) | (F.max(F.col(c).isNull()) & F.max(c).isNotNull()), F.lit(False)).alias(f"use_{c}")
            for c in features]
    return ref.groupBy(*keys).agg(*aggs) if aggs else ref.select(*keys).distinct()


def prepare_target(df: DataFrame, target: str) -> DataFrame:
    """F1 + F2 applied once at ingest (quirk Q8: labels compare as int text)."""
    return df.withColumn(target, float_string_label(clean_target(target)))


def fit(train: DataFrame, spec: ModelSpec, filter_rare: bool = True, config: DataFrame | None = None) -> Model:
    """Clean target, class counts, rare-class filter, masks, stats.

    Training materialises the training lines and the model tables (reference rows,
    class counts, per-group stats and masks) under ``spark.checkpoint.dir``, as the
    reference's training step writes its artefacts; scoring reads them.

    ``config`` (S20, from ``registry.resolve_config``): per group its features, k and
    weights, and optionally ``source``; all groups are still trained and scored in one job,
    as a feature that a group does not use is masked there.  Features that are none of the
    spec's are left out; groups without a row take the spec's features, k and weights.
    """
    keys = list(spec.group_keys)
    features = list(spec.numeric) + list(spec.categorical)
    prep = materialize(prepare_target(train, spec.target), "model_train")  # what makes the lines (joins, shuffles) runs once, not once a table below
    counts = materialize(profile.class_counts(prep, keys, spec.target), "model_class_counts")
    kept = profile.rare_classes(counts, keys)
    if filter_rare:
        tr = profile.filter_rare(prep, kept, keys, spec.target)
    else:
        kept = kept.withColumn("kept", F.lit(True))
        tr = prep
    # Groups that the skip rules name get no model; emptied groups stay in the list
    groups = counts.select(*keys).distinct()
    choice = groups.select(*keys, F.array(*[F.lit(c) for c in features]).cast("array<string>").alias("features"), F.lit(spec.k).alias("k"), F.lit(spec.weights).alias("weights"), F.lit("spec").alias("source"))
    if config is not None:
        source = F.coalesce("source", F.lit("config")) if "source" in config.columns else F.lit("config")
        own = config.select(*keys, F.array_intersect(F.array(*[F.lit(c) for c in features]), F.col("features")).alias("_f"), F.col("k").cast("int").alias("_k"), F.col("weights").alias("_w"), source.alias("_s"))
        choice = choice.join(own, keys, "left").select(*keys, *[F.coalesce(o, n).alias(n) for o, n in (("_f", "features"), ("_k", "k"), ("_w", "weights"), ("_s", "source"))])

    def feature_use(rows: DataFrame) -> DataFrame:
        mask = feature_mask(rows, keys, features)
        return mask if config is None else mask.join(choice, keys).select(*keys, *[(F.col(f"use_{c}") & F.array_contains("features", c)).alias(f"use_{c}") for c in features])

    if config is None:  # a spec without a varying feature still ranks by id
        state_groups = groups
    else:
        used = [F.col(f"use_{c}").cast("int") for c in features] or [F.lit(0)]
        state_groups = choice.join(feature_use(tr).select(*keys, (reduce(operator.add, used) > 0).alias("has_features")), keys, "left").select(*keys, "k", "has_features")
    state = materialize(profile.trainable_groups(tr, keys, spec.target, spec.k, groups=state_groups), "model_state")
    trained = state.filter("state = 'FINISHED'").select(*keys)
    # where nothing is left out, the written lines are the reference rows
    missing = reduce(operator.or_, [F.col(c).isNull() for c in (*keys, "class")])
    whole = kept.filter(~F.col("kept") | missing).isEmpty() and state.filter("state <> 'FINISHED'").isEmpty()
    tr = prep if whole else materialize(tr.join(trained, keys, "left_semi"), "model_ref")
    if not whole:
        discard(prep)
    stats = fe.numeric_stats_wide(tr, keys, spec.numeric)
    groups = materialize(stats.join(feature_use(tr), keys).join(choice, keys), "model_groups")
    values = materialize(fe.category_values(tr, keys, spec.categorical), "model_values") if spec.categorical else tr.select(*keys, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("value")).limit(0)
    most_k = spec.k if config is None else max(spec.k, groups.agg(F.max("k")).first()[0] or 0)
    return _model(spec, tr, counts, kept, groups, state, values, most_k)


def _model(spec: ModelSpec, ref: DataFrame, counts: DataFrame, kept: DataFrame, groups: DataFrame, state: DataFrame, values: DataFrame, most_k: int, index: knn.Index | None = None) -> Model:
    keys = list(spec.group_keys)
    mask = groups.select(*keys, *[c for c in groups.columns if c.startswith("use_")])
    stats = groups.select(*keys, *[c for c in groups.columns if c.startswith("_mean") or c.startswith("_std")])
    return Model(spec=spec, ref=ref, counts=counts, kept=kept, stats=stats, mask=mask, state=state, values=values, choice=groups.select(*keys, "features", "k", "weights", "source"), most_k=most_k, index=index)


#: Artefacts of a saved model (S11): what each holds is what ``fit`` materialises.
MODEL_TABLES = ("model_lines", "model_categories", "model_groups", "model_runs", "model_values")
INDEX_TABLES = ("model_index", "model_marks")


def save_model(model: Model, base: str, run_ts: str) -> None:
    """Writes one run of a model: reference lines, class counts, group statistics, masks and configs, group states,
    category values and the neighbour index; the manifest last."""
    keys = list(model.spec.group_keys)
    frames = dict(zip(MODEL_TABLES, (model.ref, model.kept, model.stats.join(model.mask, keys).join(model.choice, keys), model.state, model.values), strict=True))
    if not model.spec.vector:
        frames |= dict(zip(INDEX_TABLES, model.neighbor_index().tables(), strict=True))
    registry.save_run(frames, model.state, base, run_ts)


def _schemas(spec: ModelSpec) -> dict[str, T.StructType]:
    """Columns of the artefacts where none was ever written."""
    cols = {
        "model_lines": [(c, "string") for c in (*spec.group_keys, spec.id_col, spec.target, *spec.categorical)] + [(c, "double") for c in spec.numeric] + [(spec.vector, "array<double>")] * bool(spec.vector),
        "model_categories": [*((c, "string") for c in (*spec.group_keys, "class")), ("n", "long"), ("kept", "boolean")],
        "model_groups": [*((c, "string") for c in spec.group_keys), *((f"{s}{i}", "double") for i in range(len(spec.numeric)) for s in ("_mean", "_std")), *((f"use_{c}", "boolean") for c in spec.features),
                         ("features", "array<string>"), ("k", "int"), ("weights", "string"), ("source", "string")],
        "model_runs": [*((c, "string") for c in spec.group_keys), ("n_rows", "long"), ("n_classes", "long"), ("reason", "string"), ("state", "string")],
        "model_values": [(c, "string") for c in (*spec.group_keys, "feature", "value")],
        "model_index": [*((c, "string") for c in spec.group_keys), *((c, "long") for c in ("h1", "h2", "block", "pos")), ("t_id", "string"), ("t_label", "string"), *((f"tn{i}", "double") for i in range(len(spec.numeric))), *((f"tc{i}", "string") for i in range(len(spec.categorical)))],
        "model_marks": [*((c, "string") for c in spec.group_keys), ("h1", "long"), ("h2", "long"), ("x", "double"), ("pos", "long")],
    }
    return {name: T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in of)) for name, of in cols.items() if not spec.vector or name not in INDEX_TABLES}


def load_model(spark: SparkSession, base: str, spec: ModelSpec, version: str | None = None) -> Model:
    """Every tenant's model of its latest (or a given) run; without any run, a model of no group."""
    runs, art = registry.read_run(spark, base, _schemas(spec), version)
    ref, kept, groups, state, values = (art[name] for name in MODEL_TABLES)
    most_k = max(spec.k, groups.agg(F.max("k")).first()[0] or 0)
    index = None if spec.vector else knn.Index(art["model_index"], art["model_marks"], most_k + 1)
    model = _model(spec, ref, kept.drop("kept"), kept, groups, state, values, most_k, index)
    model.runs = runs
    return model


def rejected(model: Model, lines: DataFrame) -> DataFrame:
    """Lines that ``predict`` cannot score: keys, q_id, reason.

    Reason: the skip rule of the group's training, ``no_model`` for groups it never saw,
    ``no_vector`` for a missing vector feature.
    """
    spec, keys = model.spec, list(model.spec.group_keys)
    j = lines.join(model.state.select(*keys, F.col("reason").alias("_why"), F.lit(True).alias("_seen")), keys, "left")
    missing = F.col(spec.vector).isNull() if spec.vector else F.lit(False)
    reason = F.when(F.col("_seen").isNull(), F.lit("no_model")).when(F.col("_why").isNotNull(), F.col("_why")).when(missing, F.lit("no_vector"))
    return j.select(*keys, F.col(spec.id_col).alias("q_id"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def neighbors(model: Model, queries: DataFrame, *, exclude_self: bool = False,
              k: int | None = None) -> DataFrame:
    """C3 + J9: standardise, flag unseen categories, exact k nearest reference rows."""
    spec, keys = model.spec, list(model.spec.group_keys)
    if spec.vector:
        if spec.numeric or spec.categorical:
            raise ValueError("a vector feature stands alone")
        return knn.knn_vectors(queries.join(model.stats.select(*keys), keys, "left_semi"), model.ref, keys=keys, q_id=spec.id_col, t_id=spec.id_col,
                               t_label=spec.target, vec=spec.vector, k=k or spec.k, exclude_self=exclude_self)
    qz = fe.known_values(fe.with_scale(queries, model.stats, keys, spec.numeric), model.values, keys, spec.categorical)
    own_k = {}
    if k is None:
        qz, own_k = qz.join(model.choice.select(*keys, F.col("k").alias("_own_k")), keys), {"k_col": "_own_k"}
    how = {"q_id": spec.id_col, "scale": [f"s_{c}" for c in spec.numeric], "known": [f"known_{c}" for c in spec.categorical], "k": k or model.most_k,
           "exclude_self": exclude_self, **own_k, **model.columns()}
    if model.index is None:  # neither saved nor loaded
        return knn.knn_join(qz, fe.with_scale(model.ref, model.stats, keys, spec.numeric), t_id=spec.id_col, t_label=spec.target, **how)
    return knn.knn_probe(model.neighbor_index(k or 0), qz, **how)


def class_frequency(model: Model, lines: DataFrame, booked_col: str,
                    id_col: str | None = None) -> DataFrame:
    """Share of the booked class among reference rows *before* rare-class removal.

    A class that is absent or was removed scores 0.
    """
    keys = list(model.spec.group_keys)
    tot = model.counts.groupBy(*keys).agg(F.sum("n").alias("_tot"))
    freq = (model.kept.join(tot, keys)
            .select(*[F.col(k).alias(f"_fk{i}") for i, k in enumerate(keys)], F.col("class").alias("_cls"),
                    F.when(F.col("kept"), F.col("n") / F.col("_tot")).otherwise(F.lit(0.0)).alias("_f")))
    booked = float_string_label(clean_target(booked_col))
    cond = [F.col(k) == F.col(f"_fk{i}") for i, k in enumerate(keys)] + [F.col("_b") == F.col("_cls")]
    j = lines.withColumn("_b", booked).join(freq, cond, "left")
    return j.select(*lines.columns,
                    F.round(F.coalesce(F.col("_f"), F.lit(0.0)), 9).alias("class_frequency"))


def predict(model: Model, queries: DataFrame, weights: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(neighbours, predictions) for every line of a trained group; ``rejected`` lists the others.

    Each group votes with its own k and weighting (``Model.choice``); ``weights`` overrides the latter.
    """
    nb = neighbors(model, queries)
    return nb, knn.vote(nb, model.spec.group_keys, weights or model.choice)


def anomalies(predictions: DataFrame, booked_col: str = "booked") -> DataFrame:
    """Lines whose prediction differs from the booked value (both F2-normalised)."""
    p = float_string_label(F.col("prediction"))
    b = float_string_label(clean_target(booked_col))
    return predictions.filter(~p.eqNullSafe(b))


def audit(model: Model, lines: DataFrame, weights: str | None = None) -> DataFrame:
    """Score lines, attach booked class and its frequency, keep disagreements."""
    spec, keys = model.spec, list(model.spec.group_keys)
    _, pred = predict(model, lines, weights)
    booked = lines.select(*keys, F.col(spec.id_col).alias("q_id"), F.col(spec.target).alias("booked"))
    j = pred.join(booked, keys + ["q_id"])
    j = class_frequency(model, j, "booked")
    return anomalies(j, "booked")


def result_rows(model: Model, lines: DataFrame, weights: str | None = None) -> DataFrame:
    """One row per scored line: keys, q_id, prediction, score, booked class and its frequency, explanations.

    ``explanations`` is the ranked list of neighbours (rank, t_id, t_label, distance).
    """
    spec, keys = model.spec, list(model.spec.group_keys)
    nb, pred = predict(model, lines, weights)
    why = nb.groupBy(*keys, "q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t_id", "t_label", "distance"))).alias("explanations"))  # k per line
    booked = lines.select(*keys, F.col(spec.id_col).alias("q_id"), float_string_label(clean_target(spec.target)).alias("booked"))
    return class_frequency(model, pred.join(booked, keys + ["q_id"]).join(why, keys + ["q_id"]), "booked")


def audit_range(tables: list[tuple[Model, DataFrame]], start=None, end=None) -> DataFrame:
    """C18 over several line tables: ``audit`` of the lines dated ``start``..``end`` (inclusive, None: unbounded), appended."""
    out = None
    for model, lines in tables:  # one entry per line table, all tenants at once
        found = audit(model, date_range(lines, model.spec.date_col, start, end))
        found = found.withColumn("q_id", F.col("q_id").cast("string"))
        out = found if out is None else out.unionByName(found)
    return out


_FOUND = "tenant_id string, table_name string, q_id string, prediction string, score double, booked string, class_frequency double"


def audit_tables(spark: SparkSession, tables: dict[str, tuple[ModelSpec, DataFrame, DataFrame]], start=None, end=None, *,
                 skip_failing: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """C18 from the training rows on: (findings of all line tables, reason by table that failed).

    ``tables``: by name the spec, the training lines and the lines to audit.  A table that fails (a
    missing column, a check of its plan) ends the audit, or with ``skip_failing`` is left out and
    named; each table's findings are written as they are found, so a failure costs no other table.
    The findings alone do not tell a failed table from one without findings: who skips must read the reasons.
    """
    def found(name: str) -> DataFrame | str:
        spec, train, lines = tables[name]
        try:
            return materialize(audit_range([(fit(train, spec), lines)], start, end), f"audit_{name}")
        except PySparkException as e:
            if not skip_failing:
                raise
            return e.getCondition() or type(e).__name__

    out, failed = spark.createDataFrame([], _FOUND), {}
    for name, rows in zip(tables, side_by_side([partial(found, name) for name in tables]), strict=True):  # one entry per line table, all tenants at once
        if isinstance(rows, str):
            failed[name] = rows
        else:
            out = out.unionByName(rows.select(out.columns))
    return out, failed


def model_card(model: Model) -> DataFrame:
    """One row per trained group, what its answers were made with.

    target, used features by kind, constant_columns (features left out as constant or unselected), k, weights, where
    they come from, class counts before the rare classes went, those classes, rows, one-hot input
    dimension, and the run that a loaded model was read from (else null).
    """
    spec, keys = model.spec, list(model.spec.group_keys)

    def named(features, used: bool):
        return F.array_compact(F.array(*[F.when(F.col(f"use_{c}") == F.lit(used), F.lit(c)) for c in features]).cast("array<string>"))

    def size(name: str, features):
        return sum((F.col(f"use_{c}").cast("int") * F.col(f"{name}_{c}") for c in features), F.lit(0))

    rows = model.ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_samples"))
    values = model.values.groupBy(*keys).agg(F.lit(0).alias("_none"), *[F.count_if(F.col("feature") == c).alias(f"_values_{c}") for c in spec.categorical])
    d = model.mask.join(model.choice, keys).join(rows, keys).join(values, keys, "left")
    d = d.join(profile.class_count_map(model.counts, keys), keys, "left").join(profile.removed_classes(model.kept, keys), keys, "left")
    if model.runs is None:
        d = d.withColumn("run_ts", F.lit(None).cast("string"))
    else:
        d = d.join(model.runs.select("tenant_id", "run_ts"), "tenant_id", "left")
    numeric = sum((F.col(f"use_{c}").cast("int") for c in spec.numeric), F.lit(0))
    return d.select(*keys, F.lit(spec.target).alias("target_variable"), named(spec.categorical, True).alias("categorical_features"), named(spec.numeric, True).alias("numerical_features"),
                    named(spec.features, False).alias("constant_columns"), F.col("k").alias("n_neighbors"), "weights", "source", "class_counts",
                    F.coalesce("removed_classes", F.array().cast("array<string>")).alias("removed_classes"), "num_samples",
                    (numeric + size("_values", spec.categorical)).cast("long").alias("input_dim"), "run_ts")


def train_summary(model: Model) -> DataFrame:
    """Per group the trainable state (P15) and the training accuracy.

    Training accuracy scores the reference rows against themselves (each row
    is its own neighbour at distance 0), as the reference's self-score does.
    """
    spec, keys = model.spec, list(model.spec.group_keys)
    state = model.state
    _, pred = predict(model, model.ref)
    truth = model.ref.select(*keys, F.col(spec.id_col).alias("q_id"), F.col(spec.target).alias("_y"))
    acc = (pred.join(truth, keys + ["q_id"]).groupBy(*keys)
               .agg(F.round(F.avg((F.col("prediction") == F.col("_y")).cast("double")), 9).alias("train_accuracy")))
    return state.join(acc, keys, "left")


def explanation_records(neighbors: DataFrame, raw: DataFrame, keys, id_col: str, cols) -> DataFrame:
    """Attach the record of every neighbour (first raw row per id)."""
    keys = list(keys)
    # several rows of an id: the first in the order of the columns asked for
    row = F.min(F.struct(*[F.col(c).alias(f"t_{c}") for c in cols])).alias("_row")
    one = raw.groupBy(*keys, F.col(id_col).alias("t_id")).agg(row).select(*keys, "t_id", "_row.*")
    return neighbors.join(one, keys + ["t_id"], "left")
