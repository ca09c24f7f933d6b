"""Scans over parquet tables.

Filters and projections are expressed on the DataFrame so Catalyst pushes
them into the parquet scan (``PushedFilters`` / ``ReadSchema``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def date_range(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Inclusive ``BETWEEN`` on ``col``; a missing bound means unbounded."""
    c = F.col(col)
    if start is not None:
        df = df.filter(c >= F.lit(start).cast(df.schema[col].dataType))
    if end is not None:
        df = df.filter(c <= F.lit(end).cast(df.schema[col].dataType))
    return df


def scan_filter_limit(df: DataFrame, *, id_col: str = "id", tenant_col: str = "tenant_id",
                      tenant=None, created_col: str | None = None, start=None, end=None,
                      limit: int | None = None) -> DataFrame:
    """S3: optional tenant filter, inclusive created range, ORDER BY id, LIMIT n.

    With a limit Spark plans ``TakeOrderedAndProject`` (per-partition top-n,
    then a merge of n rows per partition) -- no global sort of the table.
    """
    if tenant is not None:
        df = df.filter(F.col(tenant_col) == F.lit(tenant))
    if created_col is not None:
        df = date_range(df, created_col, start, end)
    df = df.orderBy(F.col(id_col).asc())
    return df.limit(limit) if limit is not None else df


#: Rows that a page may keep on the driver, with those before it; pages further on are found by counting.
PAGE_ROWS = 100_000


def page(df: DataFrame, order_cols: list[str | Column], page_no: int, page_size: int) -> DataFrame:
    """W2 as a user-facing operator: rows ``[page_no*size, (page_no+1)*size)`` in a total order.

    First pages are a top-n.  For a deep page the rows are range-partitioned by the order and counted
    by partition; only the partitions that the page touches are sorted, and no row passes the driver.
    ``page_after`` reads on from a key at any depth without a pass over the earlier rows.
    """
    first, end = page_no * page_size, (page_no + 1) * page_size
    if end <= PAGE_ROWS:
        return df.orderBy(*order_cols).offset(first).limit(page_size)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order_cols).withColumn("_part", F.spark_partition_id()), "page_ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    touched = counts.filter((F.col("_before") < end) & (F.col("_before") + F.col("_n") > first)).select("_part", "_before")
    inside = Window.partitionBy("_part").orderBy(*order_cols)
    placed = ranged.join(F.broadcast(touched), "_part").withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1)
    return placed.filter(F.col("_at").between(first, end - 1)).orderBy("_at").select(*df.columns)


def page_after(df: DataFrame, key: str, last, page_size: int) -> DataFrame:
    """W2 keyed: the ``page_size`` rows after the key ``last`` (None: the first), in order of the unique ``key``.

    The key predicate reaches the scan, and only a page of rows is kept, whatever the depth.
    """
    rows = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(page_size)


def tenants(df: DataFrame, specific=None, tenant_col: str = "tenant_id") -> DataFrame:
    """Distinct tenants; the given tenant if it exists, otherwise all tenants."""
    t = df.select(F.col(tenant_col).alias("tenant_id")).distinct()
    if specific is None:
        return t
    one = t.filter(F.col("tenant_id") == F.lit(specific))
    return t if one.isEmpty() else one


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, nullable, ordinal) for registered tables."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, i + 1)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, is_nullable boolean, ordinal long"
    ).orderBy("table_name", "ordinal")
