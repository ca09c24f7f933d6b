"""Evaluation of predictions against a labelled hold-out.

Everything is computed per group ``keys`` (normally ``(tenant_id,
table_name)``) from the long confusion table, which has at most
``labels^2`` rows per group -- the metrics never touch the scored rows twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.labels import clean_target, float_string_label
from ledgerlens.sources import registry

METRIC_DECIMALS = 4


def eval_join(predictions: DataFrame, truth: DataFrame, keys, *, pred_id: str = "q_id",
              truth_id: str = "id", truth_col: str = "correct_target_variable",
              pred_col: str = "prediction", strict: bool = True) -> DataFrame:
    """Predictions JOIN truth on (keys, line id); labels F1/F2-normalised.

    Returns ``(keys..., q_id, y_true, y_pred, <other prediction columns>)``.  An id must
    have one truth row: otherwise the job fails (``strict``), or the id is left out and
    :func:`duplicate_truth` lists it.
    """
    keys = list(keys)
    t = one_truth(truth, keys, truth_id=truth_id, truth_col=truth_col, strict=strict).withColumnRenamed(truth_id, pred_id)
    p = predictions.withColumn("y_pred", float_string_label(F.col(pred_col)))
    return p.join(t, keys + [pred_id], "inner")


def one_truth(truth: DataFrame, keys, *, truth_id: str = "id", truth_col: str = "correct_target_variable", strict: bool = True) -> DataFrame:
    """``(keys, truth_id, y_true)``: the truth of ids with one row, checked in the plan (one aggregate, no second pass)."""
    keys = list(keys)
    one = truth.groupBy(*keys, truth_id).agg(F.count(F.lit(1)).alias("_n"), F.min(float_string_label(clean_target(truth_col))).alias("y_true"))
    if strict:
        message = F.concat(F.lit("several truth rows of id "), F.coalesce(F.col(truth_id).cast("string"), F.lit("null")))
        return one.select(*keys, truth_id, F.when(F.col("_n") == 1, F.col("y_true")).otherwise(F.raise_error(message).cast("string")).alias("y_true"))
    return one.filter("_n = 1").select(*keys, truth_id, "y_true")


def duplicate_truth(truth: DataFrame, keys, truth_id: str = "id") -> DataFrame:
    """Ids with more than one truth row (must be empty for a valid evaluation)."""
    return truth.groupBy(*keys, truth_id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def labels(ev: DataFrame, keys) -> DataFrame:
    """Distinct union of true and predicted labels per group."""
    return (ev.select(*keys, F.col("y_true").alias("label"))
              .union(ev.select(*keys, F.col("y_pred").alias("label"))).distinct())


def confusion_long(ev: DataFrame, keys) -> DataFrame:
    """Full confusion matrix over the union of labels, zeros included."""
    keys = list(keys)
    lab = labels(ev, keys)
    cells = (lab.withColumnRenamed("label", "y_true")
                .join(lab.withColumnRenamed("label", "y_pred"), keys))
    return (cells.join(confusion_counts(ev, keys), keys + ["y_true", "y_pred"], "left")
                 .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long"))))


def confusion_counts(ev: DataFrame, keys) -> DataFrame:
    """A15 without the zeros: rows per (true, predicted) pair that occurs; enough for all metrics."""
    return ev.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_pivot(conf: DataFrame, keys, label_values) -> DataFrame:
    """A15 wide form: one row per true label, one column for each of ``label_values`` (null: not a label of the group)."""
    return conf.groupBy(*keys, "y_true").pivot("y_pred", list(label_values)).agg(F.sum("n"))


def class_marginals(conf: DataFrame, keys) -> DataFrame:
    """Per (group, label): tp, true count (support), predicted count."""
    keys = list(keys)
    t = conf.groupBy(*keys, F.col("y_true").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))
                                           .otherwise(0)).alias("tp"))
    p = conf.groupBy(*keys, F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    return t.join(p, keys + ["label"], "full").fillna(0, ["support", "tp", "predicted"])


def eval_metrics(conf: DataFrame, keys) -> DataFrame:
    """Accuracy, balanced accuracy, weighted P/R/F1, MCC, recommended.

    Weighted scores use the labels present in the truth with support weights
    and zero-division 0; MCC is the multiclass form, 0 when undefined.
    Recommended: MCC for exactly two true classes, else weighted F1.
    """
    keys = list(keys)
    m = class_marginals(conf, keys)
    sup, tp, pr = F.col("support"), F.col("tp"), F.col("predicted")
    prec = F.when(pr > 0, tp / pr).otherwise(F.lit(0.0))
    rec = F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))
    f1 = F.when((prec + rec) > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    g = m.groupBy(*keys).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("correct"),
        F.count_if(sup > 0).alias("n_true_classes"),
        F.avg(F.when(sup > 0, rec)).alias("balanced_accuracy"),
        F.sum(sup * prec).alias("_wp"), F.sum(sup * rec).alias("_wr"), F.sum(sup * f1).alias("_wf"),
        F.sum(pr.cast("double") * sup.cast("double")).alias("_pt"),
        F.sum(pr.cast("double") * pr.cast("double")).alias("_pp"),
        F.sum(sup.cast("double") * sup.cast("double")).alias("_tt"))
    n = F.col("n").cast("double")
    c = F.col("correct").cast("double")
    den = (n * n - F.col("_pp")) * (n * n - F.col("_tt"))
    mcc = F.when(den == 0, F.lit(0.0)).otherwise((c * n - F.col("_pt")) / F.sqrt(den))
    r = lambda x: F.round(x, METRIC_DECIMALS)
    out = g.select(
        *keys, "n", "n_true_classes",
        r(c / n).alias("accuracy"), r(F.col("balanced_accuracy")).alias("balanced_accuracy"),
        r(F.col("_wp") / n).alias("precision_weighted"), r(F.col("_wr") / n).alias("recall_weighted"),
        r(F.col("_wf") / n).alias("f1_weighted"), r(mcc).alias("mcc"))
    return out.withColumn(
        "recommended_metric", F.when(F.col("n_true_classes") == 2, F.lit("Matthews Correlation"))
        .otherwise(F.lit("F1-Score (Weighted)"))).withColumn(
        "recommended_score", F.when(F.col("n_true_classes") == 2, F.col("mcc")).otherwise(F.col("f1_weighted")))


def per_class_metrics(conf: DataFrame, keys, train_counts: DataFrame | None = None) -> DataFrame:
    """One-vs-rest TP/FP/FN/TN, precision, recall, accuracy, share for true classes."""
    keys = list(keys)
    m = class_marginals(conf, keys)
    tot = m.groupBy(*keys).agg(F.sum("support").alias("total"))
    m = m.join(tot, keys).filter(F.col("support") > 0)
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    out = m.select(*keys, F.col("label").alias("class"), F.col("support").alias("num_samples_in_eval"),
                   F.round(F.col("support") / F.col("total") * 100, 6).alias("pct_in_eval"),
                   tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                   (F.col("total") - tp - fp - fn).alias("tn"),
                   F.round(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)), 6).alias("precision"),
                   F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)), 6).alias("recall"),
                   F.round((F.col("total") - fp - fn) / F.col("total"), 6).alias("accuracy"))
    if train_counts is not None:
        tc = train_counts.select(*keys, F.col("class"), F.col("n").alias("num_samples_in_train"))
        out = (out.join(tc, keys + ["class"], "left")
                  .withColumn("num_samples_in_train", F.coalesce("num_samples_in_train", F.lit(0).cast("long"))))
    return out


def summary_metrics(per_class: DataFrame, keys) -> DataFrame:
    """Macro average and support-weighted average rows per group."""
    keys = list(keys)
    w = F.col("num_samples_in_eval")
    has_train = "num_samples_in_train" in per_class.columns
    common = [F.sum(w).alias("num_samples_in_eval"), F.round(F.sum("pct_in_eval"), 6).alias("pct_in_eval")]
    if has_train:
        common.append(F.sum("num_samples_in_train").alias("num_samples_in_train"))
    macro = per_class.groupBy(*keys).agg(
        *common, *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "accuracy")]
    ).withColumn("class", F.lit("Macro Avg"))
    weighted = per_class.groupBy(*keys).agg(
        *common, *[F.round(F.sum(F.col(c) * w) / F.sum(w), 6).alias(c) for c in ("precision", "recall", "accuracy")]
    ).withColumn("class", F.lit("Weighted Avg"))
    return macro.unionByName(weighted)


def result_table(scored: DataFrame, keys) -> DataFrame:
    """A30 (C17): per scored line, error flag, class frequency in percent, distances."""
    out = scored.select(*keys, "q_id", F.col("y_pred").alias("prediction"), F.col("y_true").alias("ground_truth"),
                        (~F.col("y_pred").eqNullSafe(F.col("y_true"))).alias("is_error"),
                        F.round(F.col("class_frequency") * 100, 2).alias("class_frequency"),
                        "min_distance", "max_distance", "avg_distance")
    return out.orderBy(F.col("is_error").desc(), F.col("class_frequency").desc(), "q_id")


def error_groups(results: DataFrame, keys) -> DataFrame:
    """Errors by (prediction, truth): count and the (single) class frequency."""
    e = results.filter("is_error")
    return (e.groupBy(*keys, "prediction", "ground_truth")
             .agg(F.count(F.lit(1)).alias("error_count"), F.min("class_frequency").alias("class_frequency"),
                  F.count_distinct("class_frequency").alias("n_frequencies"))
             .orderBy(F.col("error_count").desc()))


def missing_features(scored: DataFrame, keys, features) -> DataFrame:
    """Null features per scored line, then mean and median by correctness."""
    n_missing = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    rows = scored.select(*keys, (~F.col("y_pred").eqNullSafe(F.col("y_true"))).alias("is_error"),
                         n_missing.alias("num_nan_features"))
    return rows.groupBy(*keys, "is_error").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("num_nan_features"), 6).alias("mean_nan_features"),
        F.median("num_nan_features").alias("median_nan_features"))


def distance_histogram(results: DataFrame, keys, bins: int = 100) -> DataFrame:
    """Counts of min/avg/max distance in ``bins`` equal bins over the common range.

    The range spans all three statistics of the group; the top edge falls in
    the last bin.  Output ``(keys..., is_error, stat, bucket, n)``.
    """
    keys = list(keys)
    long = results.select(*keys, "is_error", F.explode(F.array(
        F.struct(F.lit("min").alias("stat"), F.col("min_distance").alias("x")),
        F.struct(F.lit("avg").alias("stat"), F.col("avg_distance").alias("x")),
        F.struct(F.lit("max").alias("stat"), F.col("max_distance").alias("x")))).alias("_s")
    ).select(*keys, "is_error", "_s.*")
    # range per group by aggregation (partial min/max per task), joined back:
    # no window that would put a whole group into one task
    rng = long.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / span * bins)).cast("int")
    return (long.join(rng, keys).withColumn("bucket", b)
                .groupBy(*keys, "is_error", "stat", "bucket").agg(F.count(F.lit(1)).alias("n")))


def with_class_names(per_class: DataFrame, names: DataFrame, *, tenant_col: str = "tenant_id", code_col: str = "code", name_col: str = "name") -> DataFrame:
    """``class_name`` of every class, by (tenant, code); codes compare as labels do (F2), of several names the first."""
    one = names.groupBy(F.col(tenant_col).alias("_t"), float_string_label(code_col).alias("_c")).agg(F.min(name_col).alias("class_name"))
    j = per_class.join(one, (F.col(tenant_col) == F.col("_t")) & (F.col("class") == F.col("_c")), "left")
    return j.select(*per_class.columns, "class_name")


#: Artefacts of an evaluation (S14) and the columns that any of them has where none was written.
EVALUATION_TABLES = {"evaluation_lines": "q_id string, y_true string", "evaluation_response": "q_id string, prediction string, score double",
                     "evaluation_results": "q_id string, prediction string, ground_truth string, is_error boolean", "evaluation_confusion": "y_true string, y_pred string, n long",
                     "evaluation_metrics": "n long, accuracy double, balanced_accuracy double, f1_weighted double, mcc double"}


def save_evaluation(scored: DataFrame, response: DataFrame, keys, base: str, run_ts: str) -> None:
    """Writes one evaluation run: truth of the lines, answers, result table, confusion matrix, metrics; the manifest last.

    ``scored``: joined lines (:func:`eval_join`, class frequency, distances); ``response``: the answers as they came.
    """
    counts = confusion_counts(scored, keys)
    frames = (scored.select(*keys, "q_id", "y_true"), response, result_table(scored, keys), confusion_long(scored, keys), eval_metrics(counts, keys))
    registry.save_run(dict(zip(EVALUATION_TABLES, frames, strict=True)), scored.select("table_name", "tenant_id").distinct(), base, run_ts)


def load_evaluation(spark: SparkSession, base: str, keys, version: str | None = None) -> dict[str, DataFrame]:
    """The artefacts of every tenant's latest (or a given) evaluation, all of one run; with ``run_ts``."""
    schemas = {name: T.StructType.fromDDL(", ".join(f"{k} string" for k in keys) + ", " + cols) for name, cols in EVALUATION_TABLES.items()}
    runs, art = registry.read_run(spark, base, schemas, version)
    return {name: df.join(runs.select("tenant_id", "run_ts"), "tenant_id") for name, df in art.items()}
