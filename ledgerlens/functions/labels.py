"""Label and record cleaning as column expressions.

No Python UDF: every rule is a Catalyst expression, so it stays inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import NOT_APPLICABLE, REQUEST_NULL_TOKENS, TARGET_NULL_TOKENS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_target(c: str | Column) -> Column:
    """null and the tokens 'None', 'nan', 'NaN' become 'NOT_APPLICABLE'.

    Matching is exact ('none' stays a class), after a cast to string.
    """
    s = _c(c).cast("string")
    return F.when(s.isNull() | s.isin(*TARGET_NULL_TOKENS), F.lit(NOT_APPLICABLE)).otherwise(s)


def float_string_label(c: str | Column) -> Column:
    """an integral number written as float text becomes int text.

    '200.0' -> '200', '1e3' -> '1000', ' 7.0 ' -> '7'; '4.5', 'abc', 'inf',
    'nan' and null are returned unchanged.
    """
    s = _c(c).cast("string")
    d = s.try_cast("double")
    integral = (d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(9.0e18)) & (d == F.floor(d)))
    return F.when(integral, d.cast("long").cast("string")).otherwise(s)


def null_token(c: str | Column) -> Column:
    """True when a raw request value is a missing-value token ('nan'/'none', any case)."""
    s = _c(c).cast("string")
    return F.lower(s).isin(*REQUEST_NULL_TOKENS)


def clean_categorical(c: str | Column) -> Column:
    """F3 (categorical field): tokens -> null, otherwise the value as text."""
    s = _c(c).cast("string")
    return F.when(null_token(s), F.lit(None).cast("string")).otherwise(s)


def clean_numeric(c: str | Column) -> Column:
    """F3 (numeric field): tokens, NaN and unparseable text -> null, else double."""
    s = _c(c).cast("string")
    d = s.try_cast("double")
    return F.when(null_token(s) | d.isNull() | F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def clean_bool(c: str | Column) -> Column:
    """F3 (boolean field): 'true'/'false' any case -> boolean, anything else -> null."""
    s = F.lower(_c(c).cast("string"))
    return (F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False))
             .otherwise(F.lit(None).cast("boolean")))


def clean_records(df: DataFrame, categorical=(), numeric=(), boolean=()) -> DataFrame:
    """F3 over a frame of raw request fields, typed per declared column kind."""
    out = []
    for name in df.columns:
        if name in categorical:
            out.append(clean_categorical(name).alias(name))
        elif name in numeric:
            out.append(clean_numeric(name).alias(name))
        elif name in boolean:
            out.append(clean_bool(name).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def fill_numeric(c: str | Column, value: float = 0.0) -> Column:
    """numeric null -> constant (0.0 at train and score time)."""
    return F.coalesce(_c(c).cast("double"), F.lit(float(value)))


def day_distance(a: str | Column, b: str | Column) -> Column:
    """``abs((a - b).days)`` -- whole days floored toward -inf before abs.

    Works for dates and timestamps (a timestamp 12 h earlier is 1 day away,
    12 h later is 0 days away).
    """
    ua = F.unix_micros(_c(a).cast("timestamp"))
    ub = F.unix_micros(_c(b).cast("timestamp"))
    return F.abs(F.floor((ua - ub) / F.lit(86400 * 1000000)))
