"""Group profiles used by cleaning and skip rules.

Every profile is one grouped aggregation over ``(tenant_id, table_name)``
(map-side partial aggregation, then one shuffle of small partial states).
Per-feature results are long form ``(keys..., feature, ...)`` so a feature
can be masked per tenant without changing any schema (quirk Q3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import RARE_CLASS_MIN_ROWS, RARE_CLASS_PCT_OF_MAJORITY


def class_counts(df: DataFrame, keys, target: str) -> DataFrame:
    """A3: rows per (group, class)."""
    return df.groupBy(*keys, F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_count_map(counts: DataFrame, keys) -> DataFrame:
    """A3 nested form: one ``map<class, count>`` per group (one row per group)."""
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("class_counts"))


def rare_classes(counts: DataFrame, keys, min_rows: int = RARE_CLASS_MIN_ROWS) -> DataFrame:
    """A4 (mode 'constant'): a class is kept when it has at least ``min_rows`` rows."""
    return counts.withColumn("kept", F.col("n") >= F.lit(min_rows))


def rare_classes_pct(counts: DataFrame, keys, pct: float = RARE_CLASS_PCT_OF_MAJORITY) -> DataFrame:
    """A5 (mode 'less_than_1pct_of_majority'): threshold ``int(max * pct)`` per group."""
    w = Window.partitionBy(*keys)
    thr = F.floor(F.max("n").over(w) * F.lit(pct)).cast("long")
    return counts.withColumn("threshold", thr).withColumn("kept", F.col("n") >= F.col("threshold"))


def filter_rare(df: DataFrame, counts_kept: DataFrame, keys, target: str) -> DataFrame:
    """Keep rows of kept classes (semi join against the small class table)."""
    kept = counts_kept.filter("kept").select(*keys, F.col("class").alias(target))
    return df.join(kept, [*keys, target], "left_semi")


def removed_classes(counts_kept: DataFrame, keys) -> DataFrame:
    """List of removed classes per group (``array<string>``, sorted)."""
    return (counts_kept.filter(~F.col("kept")).groupBy(*keys)
            .agg(F.sort_array(F.collect_list("class")).alias("removed_classes")))


def _unpivot_stats(df: DataFrame, keys, features, agg_exprs) -> DataFrame:
    """One aggregation pass computing ``agg_exprs(c)`` for every feature, then long form."""
    aggs = []
    for i, c in enumerate(features):
        for name, fn in agg_exprs.items():
            aggs.append(fn(c).alias(f"{name}__{i}"))
    wide = df.groupBy(*keys).agg(*aggs)
    structs = [F.struct(F.lit(c).alias("feature"),
                        *[F.col(f"{name}__{i}").alias(name) for name in agg_exprs])
               for i, c in enumerate(features)]
    return (wide.select(*keys, F.explode(F.array(*structs)).alias("_s"))
                .select(*keys, "_s.*"))


def distinct_counts(df: DataFrame, keys, features) -> DataFrame:
    """Distinct non-null values, null presence and null count per feature."""
    return _unpivot_stats(df, keys, features, {
        "n_distinct": lambda c: F.count_distinct(F.col(c)),
        "n_null": lambda c: F.count_if(F.col(c).isNull()),
    }).withColumn("has_null", F.col("n_null") > 0)


def constant_columns(df: DataFrame, keys, features) -> DataFrame:
    """P10: a feature is constant when ``len(unique()) == 1`` counting null as a value."""
    st = distinct_counts(df, keys, features)
    n_with_null = F.col("n_distinct") + F.col("has_null").cast("long")
    return st.withColumn("n_unique", n_with_null).withColumn("is_constant", n_with_null == 1)


def valid_text_features(df: DataFrame, keys, features) -> DataFrame:
    """A text feature is usable when it has at least 2 distinct non-null values."""
    st = distinct_counts(df, keys, features)
    return st.withColumn("is_valid", F.col("n_distinct") >= 2)


def trainable_groups(df: DataFrame, keys, target: str, k: int, groups: DataFrame | None = None) -> DataFrame:
    """Group state FINISHED or SKIPPED with the first failing rule.

    Rules in order: empty, no feature that varies (where ``groups`` has a column
    ``has_features``), one class only (the intended rule, quirk Q1), fewer than
    ``max(3, k)`` rows.  ``groups``: all groups to report, also those of which the
    cleaning left no row; its column ``k`` is the group's own.
    """
    keys = list(keys)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                              F.count_distinct(F.col(target)).alias("n_classes"))
    extra = [] if groups is None else [c for c in ("k", "has_features") if c in groups.columns]
    if groups is not None:
        g = groups.select(*keys, *extra).join(g, keys, "left").fillna(0, ["n_rows", "n_classes"])
    min_rows = F.greatest(F.lit(3), F.coalesce("k", F.lit(k))) if "k" in extra else F.lit(max(3, k))
    featureless = ~F.coalesce("has_features", F.lit(False)) if "has_features" in extra else F.lit(False)
    reason = (F.when(F.col("n_rows") == 0, F.lit("empty"))
               .when(featureless, F.lit("no_features"))
               .when(F.col("n_classes") <= 1, F.lit("constant_target"))
               .when(F.col("n_rows") < min_rows, F.lit("too_few_rows"))
               .otherwise(F.lit(None).cast("string")))
    return (g.withColumn("reason", reason).drop(*extra)
             .withColumn("state", F.when(F.col("reason").isNull(), F.lit("FINISHED"))
                         .otherwise(F.lit("SKIPPED"))))


def selection_guards(df: DataFrame, keys, target: str, *, folds: int, k_max: int,
                     sample_rows: int, min_per_class: int) -> DataFrame:
    """Skip rules before model selection, first failing rule wins."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                              F.count_distinct(F.col(target)).alias("n_classes"))
    n, c = F.col("n_rows"), F.col("n_classes")
    reason = (F.when(n == 0, F.lit("empty"))
               .when(c <= 1, F.lit("constant_target"))
               .when(n < c * F.lit(min_per_class), F.lit("too_few_rows_per_class"))
               .when(n < F.lit((k_max + 1) * folds / (folds - 1)), F.lit("too_few_rows_for_cv"))
               .when(F.lit(sample_rows) < c * F.lit(min_per_class), F.lit("sample_too_small"))
               .otherwise(F.lit(None).cast("string")))
    return (g.withColumn("reason", reason)
             .withColumn("state", F.when(F.col("reason").isNull(), F.lit("READY"))
                         .otherwise(F.lit("SKIPPED"))))


def table_map(df: DataFrame, tenant_col: str = "tenant_id", table_col: str = "table_name") -> DataFrame:
    """Which tables have data, per tenant."""
    return df.groupBy(tenant_col).agg(F.sort_array(F.collect_set(table_col)).alias("tables"))
