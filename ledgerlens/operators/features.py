"""Fitted feature statistics and their application.

Instead of an in-memory scaler/encoder, the fitted state is two small tables
per group: numeric ``(keys, feature, mean, std)`` and categorical
``(keys, feature, value)``.  Applying them is a join on the group keys; the
stats side has one row per group, so AQE broadcasts it when its measured
size is under the broadcast threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _num(c: str) -> Column:
    # numeric null or NaN -> 0.0 before fitting and before scoring
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def numeric_stats_wide(ref: DataFrame, keys, numeric) -> DataFrame:
    """Mean and population std per numeric feature; std 0 -> 1 (one row per group)."""
    aggs = []
    for i, c in enumerate(numeric):
        std = F.stddev_pop(_num(c))
        aggs += [F.avg(_num(c)).alias(f"_mean{i}"),
                 F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std).alias(f"_std{i}")]
    if not aggs:
        return ref.select(*keys).distinct()
    return ref.groupBy(*keys).agg(*aggs)


def numeric_stats(ref: DataFrame, keys, numeric) -> DataFrame:
    """A8 in long form ``(keys, feature, mean, std)``."""
    wide = numeric_stats_wide(ref, keys, numeric)
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"_mean{i}").alias("mean"),
                        F.col(f"_std{i}").alias("std")) for i, c in enumerate(numeric)]
    return wide.select(*keys, F.explode(F.array(*structs)).alias("_s")).select(*keys, "_s.*")


def category_values(ref: DataFrame, keys, categorical) -> DataFrame:
    """Distinct values per categorical feature, null included ``(keys, feature, value)``."""
    structs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
               for c in categorical]
    return (ref.select(*keys, F.explode(F.array(*structs)).alias("_s"))
               .select(*keys, "_s.*").distinct())


def standardize(df: DataFrame, stats_wide: DataFrame, keys, numeric, prefix: str = "z_") -> DataFrame:
    """``z = (x - mean) / std`` (missing x: 0) with the group's stats.

    Rows of groups without stats are dropped (no model for the group; ``scoring.rejected`` lists them).
    """
    j = df.join(stats_wide, list(keys), "inner")
    zs = [((_num(c) - F.col(f"_mean{i}")) / F.col(f"_std{i}")).alias(f"{prefix}{c}") for i, c in enumerate(numeric)]
    drop = [f"_mean{i}" for i in range(len(numeric))] + [f"_std{i}" for i in range(len(numeric))]
    return j.select("*", *zs).drop(*drop)


def with_scale(df: DataFrame, stats_wide: DataFrame, keys, numeric) -> DataFrame:
    """Adds ``x_<c>`` (missing: 0) and ``s_<c>`` (the group's std): differences of x divided by s are those of z-scores.

    Equal values stay exactly equal.  Rows of groups without stats are dropped, as by ``standardize``.
    """
    j = df.join(stats_wide, list(keys), "inner")
    cols = [x for i, c in enumerate(numeric) for x in (_num(c).alias(f"x_{c}"), F.col(f"_std{i}").alias(f"s_{c}"))]
    return j.select(*df.columns, *cols)


def known_flags(df: DataFrame, ref: DataFrame, keys, categorical, prefix: str = "known_") -> DataFrame:
    """Per categorical feature: does the row's value occur on the group's reference side?

    Null counts as a value (null is a category).  One semi-style left join per
    feature against the distinct ``(keys, value)`` table of that feature.
    """
    out = df
    for i, c in enumerate(categorical):
        vals = ref.select(*[F.col(k).alias(f"_kv{j}") for j, k in enumerate(keys)],
                          F.col(c).alias("_kval")).distinct().withColumn(f"{prefix}{c}", F.lit(True))
        cond = [F.col(k) == F.col(f"_kv{j}") for j, k in enumerate(keys)]
        cond.append(F.col(c).eqNullSafe(F.col("_kval")))
        out = (out.join(vals, cond, "left")
                  .drop(*[f"_kv{j}" for j in range(len(keys))], "_kval")
                  .withColumn(f"{prefix}{c}", F.coalesce(F.col(f"{prefix}{c}"), F.lit(False))))
    return out


def known_values(df: DataFrame, values: DataFrame, keys, categorical, prefix: str = "known_") -> DataFrame:
    """``known_flags`` from the fitted category values ``(keys, feature, value)`` (see ``category_values``)."""
    out, keys = df, list(keys)
    for c in categorical:
        own = values.filter(F.col("feature") == c).select(*[F.col(k).alias(f"_kv{j}") for j, k in enumerate(keys)], F.col("value").alias("_kval"), F.lit(True).alias(f"{prefix}{c}"))
        cond = [F.col(k) == F.col(f"_kv{j}") for j, k in enumerate(keys)] + [F.col(c).cast("string").eqNullSafe(F.col("_kval"))]
        out = (out.join(own, cond, "left").drop(*[f"_kv{j}" for j in range(len(keys))], "_kval")
                  .withColumn(f"{prefix}{c}", F.coalesce(F.col(f"{prefix}{c}"), F.lit(False))))
    return out


def categorical_penalty(q: str, t: str, known: Column) -> Column:
    """F9/F10 for one categorical feature: 0 equal (null = null), 2 differ-known, 1 unknown."""
    return (F.when(F.col(q).eqNullSafe(F.col(t)), F.lit(0.0))
             .when(known, F.lit(2.0)).otherwise(F.lit(1.0)))
