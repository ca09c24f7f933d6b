"""Scoring requests as tables.

A request is ``(tenant_id, table, data: array<record>)``; all records of a
request must be of one kind.  Records are cleaned with the declared column
kinds (F3).  Unknown (tenant, table) pairs are routed to a rejected output
with a left-anti join against the model's groups.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.labels import clean_records


def read_requests(spark, path: str, record_schema: str) -> DataFrame:
    """JSON requests with a declared schema; one row per record."""
    schema = f"request_id string, tenant_id string, table string, data array<struct<{record_schema}>>"
    req = spark.read.schema(schema).json(path)
    return req.select("request_id", "tenant_id", F.col("table").alias("table_name"),
                      F.explode_outer("data").alias("record")).select(
        "request_id", "tenant_id", "table_name", "record.*")


def record_kind(record: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    """Table whose columns a record has values in: the first of ``kinds`` (table -> its own columns) with any, else null."""
    out = F.lit(None).cast("string")
    for kind, cols in reversed(list(kinds.items())):
        has = reduce(operator.or_, [record[c].isNotNull() for c in cols])
        out = F.when(has, F.lit(kind)).otherwise(out)
    return out


def read_checked_requests(spark, path: str, record_schema: str, kinds: dict[str, tuple[str, ...]], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, refused requests): all records of a request must be of the request's table.

    Checked in the request's own row, before its records are exploded.  ``strict``: a request
    that is not of one kind fails the job; else it is refused with its reason: ``mixed_kinds``,
    ``wrong_kind``, or ``malformed`` (no JSON request).
    """
    schema = f"request_id string, tenant_id string, table string, data array<struct<{record_schema}>>, _corrupt string"
    req = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    found = F.array_distinct(F.transform("data", lambda r: record_kind(r, kinds)))
    reason = (F.when(F.col("_corrupt").isNotNull() | F.col("request_id").isNull(), F.lit("malformed"))
               .when(F.size(found) > 1, F.lit("mixed_kinds"))
               .when((F.size(found) == 1) & ~found[0].eqNullSafe(F.col("table")), F.lit("wrong_kind")))
    req = req.withColumn("reason", reason)
    refused = req.filter(F.col("reason").isNotNull()).select("request_id", "tenant_id", F.col("table").alias("table_name"), "reason")
    if strict:
        message = F.concat(F.lit("request "), F.coalesce("request_id", F.lit("?")), F.lit(": "), F.col("reason"))
        req = req.withColumn("data", F.when(F.col("reason").isNull(), F.col("data")).otherwise(F.raise_error(message).cast(req.schema["data"].dataType)))
    else:
        req = req.filter(F.col("reason").isNull())
    records = req.select("request_id", "tenant_id", F.col("table").alias("table_name"), F.explode_outer("data").alias("record"))
    return records.select("request_id", "tenant_id", "table_name", "record.*"), refused


def mixed_kind_requests(records: DataFrame) -> DataFrame:
    """``check_single_type`` over exploded records: requests whose records are of more than one table."""
    return (records.groupBy("request_id").agg(F.count_distinct("table_name").alias("n_kinds"))
                   .filter(F.col("n_kinds") > 1))


def clean_request_records(records: DataFrame, categorical=(), numeric=(), boolean=()) -> DataFrame:
    """F3 per declared column kind."""
    return clean_records(records, categorical=categorical, numeric=numeric, boolean=boolean)


def route_known(records: DataFrame, model_groups: DataFrame, keys=("tenant_id", "table_name")):
    """(accepted, rejected) by whether a model exists for the record's group."""
    g = model_groups.select(*keys).distinct()
    return records.join(g, list(keys), "left_semi"), records.join(g, list(keys), "left_anti")


def validate_schema(df: DataFrame, *, table_name: str, columns, categorical, numeric, target: str,
                    date_col: str | None) -> DataFrame:
    """Config-vs-schema violations ``(table_name, rule, column)`` (empty when valid).

    Checks the schema only (no data pass): column count, presence of target,
    date, categorical and numeric columns.
    """
    have = set(df.columns)
    rows = []
    # column count is checked against the configured column list, when one is declared
    if columns is not None and len(df.columns) != len(columns):
        rows.append((table_name, "column_count", str(len(df.columns))))
    for rule, cols in (("target", [target]), ("date", [date_col] if date_col else []),
                       ("categorical", categorical), ("numeric", numeric)):
        for c in cols:
            if c not in have:
                rows.append((table_name, f"missing_{rule}", c))
    return df.sparkSession.createDataFrame(rows, "table_name string, rule string, column string")
