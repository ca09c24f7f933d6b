"""Catalogue: line tables, scans, lookups (SURVEY §7.3 group "lines")."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import lookup
from ledgerlens.plans.catalog import query
from ledgerlens.plans.sql_standins import (ACC, AD, BANK, BLI, CLAIMS, CLI, CREDIT, EVAL, ILI, INV, OF, RECEIPTS, RLI,
                                           with_)
from ledgerlens.sources import line_tables as lt
from ledgerlens.sources import standins as si
from ledgerlens.sources import tables

RANGE = ("1996-01-01", "1997-12-31")

_LINE_SQL_COLS = """'accrec_accpay' AS table_name, i.tenant_id, l.invoice_unique_id, l.line_item_id,
  l.description, l.quantity, l.line_amount, l.tax_amount, l.account_code, l.item_code,
  i.invoice_id, i.invoice_number, i.contact_name, i.total"""


def _inv(spark, d):
    return (si.invoices(spark, d), si.invoice_line_items(spark, d), si.charted_accounts(spark, d))


@query("lines_orders", with_(INV, ILI) + f"""
SELECT {_LINE_SQL_COLS}, i.type AS source_type, i.date AS journal_date
FROM ili l JOIN inv i ON l.invoice_unique_id = i.id""")
def lines_orders(spark, d):
    h, l, _ = _inv(spark, d)
    return lt.build_lines(h, l, None, si.INVOICE_PLAN, first_only=False)


@query("lines_dim", with_(INV, ILI, ACC, AD) + f"""
SELECT {_LINE_SQL_COLS}, ad.account_name, ad.account_type, i.type AS source_type, i.date AS journal_date
FROM ili l JOIN inv i ON l.invoice_unique_id = i.id
LEFT JOIN ad ON l.account_code = ad.code AND i.tenant_id = ad.tenant_id""")
def lines_dim(spark, d):
    h, l, a = _inv(spark, d)
    return lt.build_lines(h, l, a, si.INVOICE_PLAN, first_only=False)


@query("first_line", with_(INV, ILI) + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT {_LINE_SQL_COLS}, i.type AS source_type, i.date AS journal_date,
         row_number() OVER (PARTITION BY l.invoice_id ORDER BY l.line_no, l.part_no, l.supp_no) AS rn
  FROM ili l JOIN inv i ON l.invoice_unique_id = i.id) WHERE rn = 1""")
def first_line(spark, d):
    h, l, _ = _inv(spark, d)
    return lt.build_lines(h, l, None, si.INVOICE_PLAN, first_only=True)


@query("lines_first_dim", with_(INV, ILI, ACC, AD) + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT {_LINE_SQL_COLS}, ad.account_name, ad.account_type, i.type AS source_type,
         i.date AS journal_date,
         row_number() OVER (PARTITION BY l.invoice_id ORDER BY l.line_no, l.part_no, l.supp_no) AS rn
  FROM ili l JOIN inv i ON l.invoice_unique_id = i.id
  LEFT JOIN ad ON l.account_code = ad.code AND i.tenant_id = ad.tenant_id
  WHERE i.date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}') WHERE rn = 1""")
def lines_first_dim(spark, d):
    h, l, a = _inv(spark, d)
    return lt.build_lines(h, l, a, si.INVOICE_PLAN, start=RANGE[0], end=RANGE[1], first_only=True)


@query("lines_date_range", with_(INV, ILI) + f"""
SELECT {_LINE_SQL_COLS}, i.type AS source_type, i.date AS journal_date
FROM ili l JOIN inv i ON l.invoice_unique_id = i.id
WHERE i.date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'""")
def lines_date_range(spark, d):
    h, l, _ = _inv(spark, d)
    return lt.build_lines(h, l, None, si.INVOICE_PLAN, start=RANGE[0], end=RANGE[1], first_only=False)


@query("distinct_on", with_(ACC, AD) + "SELECT code, tenant_id, account_name, account_type FROM ad")
def distinct_on(spark, d):
    a = lt.account_details(si.charted_accounts(spark, d))
    return a.select(F.col("_ad_code").alias("code"), F.col("_ad_tenant").alias("tenant_id"),
                    "account_name", "account_type")


@query("lines_three_way", with_(CLAIMS, RECEIPTS, RLI, ACC, AD) + """
SELECT 'expclaim' AS table_name, c.tenant_id, l.receipt_unique_id, l.line_item_id, l.line_amount,
       l.account_code, r.receipt_id AS receipt_receipt_id, r.date AS receipt_date,
       r.status AS receipt_status, r.total AS receipt_total,
       c.expense_claim_id AS claim_expense_claim_id, c.status AS claim_status, c.total AS claim_total,
       ad.account_name, ad.account_type
FROM rli l JOIN receipts r ON l.receipt_unique_id = r.id
JOIN claims c ON r.expense_claim_unique_id = c.id
LEFT JOIN ad ON l.account_code = ad.code AND c.tenant_id = ad.tenant_id""")
def lines_three_way(spark, d):
    return lt.build_chain(
        si.expense_claims(spark, d), si.expense_claim_receipts(spark, d),
        si.receipt_line_items(spark, d), si.charted_accounts(spark, d),
        claim_key="id", receipt_fk="expense_claim_unique_id", receipt_key="id",
        line_fk="receipt_unique_id", claim_cols=("expense_claim_id", "status", "total"),
        receipt_cols=("receipt_id", "date", "status", "total"),
        line_cols=("receipt_unique_id", "line_item_id", "line_amount", "account_code"))


# stand-in type rule for the CASE operator (the library default is BANK_TYPE_RULES)
_TYPE_RULES = (("%URGENT%", "CASHPAID"), ("%LOW%", "CASHREC"))


@query("source_type_case", with_(INV) + """
SELECT id, type, CASE WHEN type LIKE '%URGENT%' THEN 'CASHPAID'
                      WHEN type LIKE '%LOW%' THEN 'CASHREC' ELSE type END AS source_type
FROM inv""")
def source_type_case(spark, d):
    h = si.invoices(spark, d)
    return h.select("id", "type", lt.source_type_case("type", _TYPE_RULES).alias("source_type"))


@query("line_counts", with_(INV, ILI) + f"""
SELECT table_name, tenant_id, count(*) AS n_lines FROM (
  SELECT 'accrec_accpay' AS table_name, i.tenant_id,
         row_number() OVER (PARTITION BY l.invoice_id ORDER BY l.line_no, l.part_no, l.supp_no) AS rn
  FROM ili l JOIN inv i ON l.invoice_unique_id = i.id
  WHERE i.date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'
    AND (i.type LIKE '%URGENT%' OR i.type LIKE '%LOW%')) WHERE rn = 1
GROUP BY table_name, tenant_id""")
def line_counts(spark, d):
    """S6 with the bank-style P5 type filter; counts the same plan the data query returns."""
    h, l, _ = _inv(spark, d)
    h = h.filter(F.col("type").like("%URGENT%") | F.col("type").like("%LOW%"))
    lines = lt.build_lines(h, l, None, si.INVOICE_PLAN, start=RANGE[0], end=RANGE[1])
    return lt.line_counts(lines)


@query("tenants", with_(INV) + """
, t AS (SELECT DISTINCT tenant_id FROM inv)
SELECT tenant_id FROM t
WHERE tenant_id = '99' OR NOT EXISTS (SELECT 1 FROM t WHERE tenant_id = '99')""")
def tenants_q(spark, d):
    """S5 with a tenant that does not exist -> every tenant."""
    return tables.tenants(si.invoices(spark, d), specific="99")


@query("tenants_one", with_(INV) + """
, t AS (SELECT DISTINCT tenant_id FROM inv)
SELECT tenant_id FROM t
WHERE tenant_id = '7' OR NOT EXISTS (SELECT 1 FROM t WHERE tenant_id = '7')""")
def tenants_one(spark, d):
    """S5 with an existing tenant -> that tenant only."""
    return tables.tenants(si.invoices(spark, d), specific="7")


@query("scan_filter_limit", with_(INV) + """
SELECT * FROM inv WHERE tenant_id = '7'
  AND updated_date_utc BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1998-12-31 00:00:00'
ORDER BY id LIMIT 100""")
def scan_filter_limit(spark, d):
    """S3: the limit is the operator's feature (fetch first n by id)."""
    return tables.scan_filter_limit(si.invoices(spark, d), tenant="7", created_col="updated_date_utc",
                                    start="1996-01-01 00:00:00", end="1998-12-31 00:00:00",
                                    limit=100)


@query("page", with_(INV) + "SELECT * FROM inv ORDER BY id LIMIT 100 OFFSET 200")
def page_q(spark, d):
    """The third page of 100 headers in id order (paging is the feature)."""
    return tables.page(si.invoices(spark, d), ["id"], 2, 100)


@query("page_after", with_(INV) + "SELECT * FROM inv WHERE id > 1000 ORDER BY id LIMIT 100")
def page_after_q(spark, d):
    """W2 keyed: the 100 headers after a given id (paging is the feature)."""
    return tables.page_after(si.invoices(spark, d), "id", 1000, 100)


@query("lookup_ids", with_(INV, ILI) + f""",
f AS (SELECT {_LINE_SQL_COLS}, i.type AS source_type, i.date AS journal_date
      FROM ili l JOIN inv i ON l.invoice_unique_id = i.id)
SELECT * FROM f WHERE substr(md5(line_item_id), 1, 1) < '2'""")
def lookup_ids_q(spark, d):
    """The evaluation set's lines among all lines, by line_item_id."""
    h, l, _ = _inv(spark, d)
    lines = lt.build_lines(h, l, None, si.INVOICE_PLAN, first_only=False)
    return lookup.lookup_ids(lines, si.eval_lines(spark, d), "line_item_id")


@query("missing_ids", with_(INV, ILI, EVAL) + """
SELECT * FROM ev WHERE source_id NOT IN (
  SELECT l.invoice_id FROM ili l JOIN inv i ON l.invoice_unique_id = i.id)""")
def missing_ids_q(spark, d):
    """Evaluation ids without any line, searched among all lines."""
    h, l, _ = _inv(spark, d)
    lines = lt.build_lines(h, l, None, si.INVOICE_PLAN, first_only=False)
    return lookup.missing_ids(si.eval_set(spark, d), lines, "source_id", "invoice_id")


@query("holdout_anti", with_(OF, EVAL) + """
SELECT of.* FROM of
WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.tenant_id = of.tenant_id AND ev.table_name = of.table_name
                  AND ev.source_id = 'INV-' || CAST(of.o_orderkey AS VARCHAR))""")
def holdout_anti(spark, d):
    """Training lines minus the evaluation set (same tenant and table)."""
    train = si.order_features(spark, d).withColumn(
        "source_id", F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")))
    out = lookup.remove_holdout(train, si.eval_set(spark, d),
                                keys=("tenant_id", "table_name", "source_id"))
    return out.drop("source_id")


@query("eval_slice", with_(EVAL) + """
SELECT * FROM ev WHERE task_name = 'ACCOUNT_MAPPING_VALIDATION' AND tenant_id = '3'
  AND table_name = 'accrec_accpay'""")
def eval_slice_q(spark, d):
    """Evaluation rows of one (task, tenant, table)."""
    return lookup.eval_slice(si.eval_set(spark, d), "ACCOUNT_MAPPING_VALIDATION", "3", "accrec_accpay")


_BANK_COLS = """'cashrec_cashpaid' AS table_name, h.tenant_id, l.bank_transaction_unique_id, l.line_item_id, l.description,
  l.unit_amount, l.line_amount, l.tax_amount, l.account_code, h.bank_transaction_id, h.bank_account_code, h.bank_account_name,
  h.contact_name, h.status, h.sub_total, h.total_tax, h.total, ad.account_name, ad.account_type,
  CASE WHEN h.type LIKE '%SPEND%' THEN 'CASHPAID' WHEN h.type LIKE '%RECEIVE%' THEN 'CASHREC' ELSE h.type END AS source_type,
  h.date AS journal_date"""


@query("lines_bank", with_(BANK, BLI, ACC, AD) + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT {_BANK_COLS}, row_number() OVER (PARTITION BY l.bank_transaction_id ORDER BY l.line_no, l.line_item_id) AS rn
  FROM bli l JOIN bank h ON l.bank_transaction_unique_id = h.id
  LEFT JOIN ad ON l.account_code = ad.code AND h.tenant_id = ad.tenant_id
  WHERE h.updated_date_utc BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00') WHERE rn = 1""")
def lines_bank(spark, d):
    """First lines of bank transactions updated in a range, accounts joined, type rule applied."""
    return lt.build_lines(si.bank_transactions(spark, d), si.bank_transaction_line_items(spark, d), si.charted_accounts(spark, d), si.BANK_PLAN,
                          start="1996-01-01 00:00:00", end="1997-12-31 00:00:00")


_CREDIT_COLS = """'accreccredit_accpaycredit' AS table_name, h.tenant_id, l.credit_note_unique_id, l.line_item_id, l.description,
  l.quantity, l.unit_amount, l.line_amount, l.tax_amount, l.account_code, h.credit_note_id, h.credit_note_number, h.contact_name,
  h.status, h.reference, h.sub_total, h.total_tax, h.total, ad.account_name, ad.account_type, h.type AS source_type, h.date AS journal_date"""


@query("lines_credit", with_(CREDIT, CLI, ACC, AD) + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT {_CREDIT_COLS}, row_number() OVER (PARTITION BY l.credit_note_unique_id ORDER BY l.line_no, l.line_item_id) AS rn
  FROM cli l JOIN credit h ON l.credit_note_unique_id = h.id
  LEFT JOIN ad ON l.account_code = ad.code AND h.tenant_id = ad.tenant_id) WHERE rn = 1""")
def lines_credit(spark, d):
    """First lines of credit notes with accounts."""
    return lt.build_lines(si.credit_notes(spark, d), si.credit_note_line_items(spark, d), si.charted_accounts(spark, d), si.CREDIT_PLAN)
