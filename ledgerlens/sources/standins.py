"""Stand-in source tables built from the provided TPC-H-like parquet tables.

These functions only rename / retype columns into the shapes the reference's
source tables have (see FIXTURES.md).  They do none of the jobs' work; every
operator in ledgerlens runs unchanged on real tables of the same schema.

Mapping: header = ``orders`` (tenant = the customer's nation), line =
``lineitem``, chart of accounts = ``part``, claim/receipt/receipt-line chain =
``customer``/``orders``/``lineitem``, eval set = hold-out orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.config import TASK_ACCOUNT, TASK_GST
from ledgerlens.functions.tax import type_from_rate
from ledgerlens.sources.line_tables import BANK_TYPE_RULES, LinePlan
from ledgerlens.sources.tables import read_table

# hold-out rule of the stand-in evaluation set: first md5 hex digit of the id
HOLDOUT_DIGITS = "2"  # ids whose md5 starts with '0' or '1' (about 1/8)


def holdout_flag(id_col: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.substring(F.md5(c.cast("string")), 1, 1) < F.lit(HOLDOUT_DIGITS)


def _tax_type() -> Column:
    """Tax type of a lineitem row: rates of 5 percent and more stand for 10; open lines are purchases."""
    rate = F.when(F.col("l_tax") >= 0.05, F.lit(10.0)).otherwise(F.lit(0.0))
    return type_from_rate(rate, F.col("l_linestatus") == "O").alias("tax_type")


def invoices(spark: SparkSession, base: str) -> DataFrame:
    o = read_table(spark, base, "orders")
    c = read_table(spark, base, "customer").select("c_custkey", "c_nationkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_id"),
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("invoice_number"),
        F.col("c_name").alias("contact_name"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("updated_date_utc"),
    )


def invoice_line_items(spark: SparkSession, base: str) -> DataFrame:
    l = read_table(spark, base, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("invoice_unique_id"),
        F.concat(F.lit("INV-"), F.col("l_orderkey").cast("string")).alias("invoice_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_item_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_no"),
        F.col("l_suppkey").alias("supp_no"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("description"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("line_amount"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("tax_amount"),
        F.col("l_quantity").cast("int").cast("string").alias("account_code"),
        F.col("l_partkey").cast("string").alias("item_code"),
        F.col("l_tax").alias("tax_rate"),
        _tax_type(),
    )


def charted_accounts(spark: SparkSession, base: str) -> DataFrame:
    """Several rows per (code, tenant_id), as in the reference's dimension."""
    p = read_table(spark, base, "part")
    return p.select(
        F.col("p_size").cast("string").alias("code"),
        (F.col("p_partkey") % 25).cast("string").alias("tenant_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
    )


INVOICE_PLAN = LinePlan(
    table_name="accrec_accpay",
    header_key="id",
    line_fk="invoice_unique_id",
    header_id="invoice_id",
    line_order=("line_no", "part_no", "supp_no"),
    date_col="date",
    type_col="type",
    type_rules=(),
    header_cols=("invoice_id", "invoice_number", "contact_name", "total"),
    line_cols=("invoice_unique_id", "line_item_id", "description", "quantity",
               "line_amount", "tax_amount", "account_code", "item_code"),
)


def expense_claims(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("EC-"), F.col("c_custkey").cast("string")).alias("expense_claim_id"),
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_acctbal").alias("total"),
    )


def expense_claim_receipts(spark: SparkSession, base: str) -> DataFrame:
    o = read_table(spark, base, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("expense_claim_unique_id"),
        F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("receipt_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
        (F.col("o_totalprice") * 0.1).alias("total_tax"),
        F.col("o_orderpriority").alias("contact_name"),
    )


def receipt_line_items(spark: SparkSession, base: str) -> DataFrame:
    l = read_table(spark, base, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("receipt_unique_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_item_id"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("description"),
        F.col("l_extendedprice").alias("line_amount"),
        F.col("l_tax").alias("tax_amount"),
        F.col("l_quantity").cast("int").cast("string").alias("account_code"),
        _tax_type(),
    )


def eval_set(spark: SparkSession, base: str) -> DataFrame:
    """Stand-in ``gst_account_validation_eval_set``: held-out orders' first lines.

    One row per held-out order id (orders without lines stay in: their ids are
    the ones a lookup reports missing).
    """
    o = read_table(spark, base, "orders")
    c = read_table(spark, base, "customer").select("c_custkey", "c_nationkey")
    return (o.filter(holdout_flag("o_orderkey"))
             .join(c, o.o_custkey == c.c_custkey)
             .select(F.col("o_orderkey").alias("id"),
                     F.col("c_nationkey").cast("string").alias("tenant_id"),
                     F.lit(TASK_ACCOUNT).alias("task_name"),
                     F.lit("accrec_accpay").alias("table_name"),
                     F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("source_id"),
                     F.col("o_orderpriority").alias("correct_target_variable"),
                     F.col("o_orderdate").alias("created_at")))


def order_features(spark: SparkSession, base: str) -> DataFrame:
    """kNN line-table stand-in: orders with their customer's nation as tenant.

    id ``o_orderkey``, target ``o_orderpriority``, numeric ``o_totalprice``,
    categorical ``o_orderstatus`` and ``c_mktsegment``.
    """
    o = read_table(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                  "o_totalprice", "o_orderpriority", "o_orderdate")
    c = read_table(spark, base, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.lit("accrec_accpay").alias("table_name"),
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        "c_mktsegment", "o_orderdate", "c_acctbal",
    )


def eval_lines(spark: SparkSession, base: str) -> DataFrame:
    """Stand-in evaluation rows by line: ``line_item_id`` of held-out lines, first or not."""
    l = invoice_line_items(spark, base)
    return l.filter(holdout_flag("line_item_id")).select("line_item_id")


def tax_truth(lines: DataFrame) -> DataFrame:
    """Evaluation rows of the tax task: the booked tax type of held-out lines."""
    return lines.filter(holdout_flag("line_item_id")).select(F.col("line_item_id").alias("id"), "tenant_id", F.lit(TASK_GST).alias("task_name"), "table_name",
                                                             F.col("tax_type").alias("correct_target_variable"))


def _order_headers(spark: SparkSession, base: str) -> DataFrame:
    o = read_table(spark, base, "orders")
    c = read_table(spark, base, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey)


def bank_transactions(spark: SparkSession, base: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "SPEND").when(F.col("o_orderstatus") == "F", "RECEIVE").otherwise("TRANSFER")
    return _order_headers(spark, base).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("BT-"), F.col("o_orderkey").cast("string")).alias("bank_transaction_id"),
        F.col("c_nationkey").cast("string").alias("tenant_id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("status"),
        F.concat_ws("-", kind, "o_orderpriority").alias("type"), F.col("c_mktsegment").alias("bank_account_code"), F.col("c_mktsegment").alias("bank_account_name"),
        F.col("c_name").alias("contact_name"), F.col("o_totalprice").alias("sub_total"), (F.col("o_totalprice") * 0).alias("total_tax"),
        F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("updated_date_utc"))


def _order_lines(spark: SparkSession, base: str, fk: str, header_id: str | None, prefix: str) -> DataFrame:
    l = read_table(spark, base, "lineitem")
    ids = [F.concat(F.lit(prefix), F.col("l_orderkey").cast("string")).alias(header_id)] if header_id else []
    return l.select(
        F.col("l_orderkey").alias(fk), *ids, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_item_id"),
        F.col("l_linenumber").alias("line_no"), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("description"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("unit_amount"), F.col("l_extendedprice").alias("line_amount"), F.col("l_tax").alias("tax_amount"),
        F.col("l_quantity").cast("int").cast("string").alias("account_code"), _tax_type())


def bank_transaction_line_items(spark: SparkSession, base: str) -> DataFrame:
    return _order_lines(spark, base, "bank_transaction_unique_id", "bank_transaction_id", "BT-")


BANK_PLAN = LinePlan(
    table_name="cashrec_cashpaid", header_key="id", line_fk="bank_transaction_unique_id", header_id="bank_transaction_id",
    line_order=("line_no", "line_item_id"), date_col="date", range_col="updated_date_utc", type_col="type", type_rules=BANK_TYPE_RULES,
    header_cols=("bank_transaction_id", "bank_account_code", "bank_account_name", "contact_name", "status", "sub_total", "total_tax", "total"),
    line_cols=("bank_transaction_unique_id", "line_item_id", "description", "unit_amount", "line_amount", "tax_amount", "account_code"))


def credit_notes(spark: SparkSession, base: str) -> DataFrame:
    return _order_headers(spark, base).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("CN-"), F.col("o_orderkey").cast("string")).alias("credit_note_id"),
        F.col("c_nationkey").cast("string").alias("tenant_id"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("credit_note_number"),
        F.col("c_name").alias("contact_name"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("type"), F.col("c_mktsegment").alias("reference"), F.col("o_totalprice").alias("sub_total"),
        (F.col("o_totalprice") * 0).alias("total_tax"), F.col("o_totalprice").alias("total"))


def credit_note_line_items(spark: SparkSession, base: str) -> DataFrame:
    return _order_lines(spark, base, "credit_note_unique_id", None, "CN-")


CREDIT_PLAN = LinePlan(
    table_name="accreccredit_accpaycredit", header_key="id", line_fk="credit_note_unique_id", header_id="credit_note_unique_id",
    line_order=("line_no", "line_item_id"), date_col="date", type_col="type",
    header_cols=("credit_note_id", "credit_note_number", "contact_name", "status", "reference", "sub_total", "total_tax", "total"),
    line_cols=("credit_note_unique_id", "line_item_id", "description", "quantity", "unit_amount", "line_amount", "tax_amount", "account_code"))
