"""Tax type <-> name <-> rate dimension (F17), as a small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: tax types, descriptive names, rates (percent) ----------
TAX_TYPES = (
    ("OUTPUT", "GST on Income", 10.0),
    ("INPUT", "GST on Expenses", 10.0),
    ("EXEMPTEXPENSES", "GST Free Expenses", 0.0),
    ("EXEMPTOUTPUT", "GST Free Income", 0.0),
    ("BASEXCLUDED", "BAS Excluded", 0.0),
    ("GSTONIMPORTS", "GST on Imports", 0.0),
)
# rate lookup: 10 -> INPUT (expenses) / OUTPUT (income); 0 -> exempt expenses / income
RATE_RULES = ((10.0, True, "INPUT"), (10.0, False, "OUTPUT"),
              (0.0, True, "EXEMPTEXPENSES"), (0.0, False, "EXEMPTOUTPUT"))
# ---------------------------------------------------------------------------


def tax_types(spark: SparkSession) -> DataFrame:
    """The 6-row dimension (tax_type, tax_name, tax_rate); safe to broadcast."""
    return spark.createDataFrame(list(TAX_TYPES), "tax_type string, tax_name string, tax_rate double")


def type_from_rate(rate: str | Column, is_input: str | Column) -> Column:
    """``from_rate``: rate 10 -> INPUT/OUTPUT, rate 0 -> exempt in/out, else null."""
    r = F.col(rate) if isinstance(rate, str) else rate
    i = F.col(is_input) if isinstance(is_input, str) else is_input
    out = None
    for rr, inp, t in RATE_RULES:
        cond = (r == F.lit(rr)) & (i == F.lit(inp))
        out = F.when(cond, F.lit(t)) if out is None else out.when(cond, F.lit(t))
    return out.otherwise(F.lit(None).cast("string"))


def with_tax_names(df: DataFrame, type_col: str, spark: SparkSession, prefix: str = "") -> DataFrame:
    """Attach name and rate of ``type_col`` via a broadcast join of the 6-row table."""
    dim = tax_types(spark).select(F.col("tax_type").alias("_tt"),
                                  F.col("tax_name").alias(f"{prefix}tax_name"),
                                  F.col("tax_rate").alias(f"{prefix}tax_rate"))
    return df.join(F.broadcast(dim), F.col(type_col) == F.col("_tt"), "left").drop("_tt")


def with_type_from_name(df: DataFrame, name_col: str, spark: SparkSession,
                        out: str = "tax_type_from_name") -> DataFrame:
    """``from_name``: case-insensitive match of a descriptive name to its type."""
    dim = tax_types(spark).select(F.lower("tax_name").alias("_tn"), F.col("tax_type").alias(out))
    return df.join(F.broadcast(dim), F.lower(F.col(name_col)) == F.col("_tn"), "left").drop("_tn")
