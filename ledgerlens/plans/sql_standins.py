"""The stand-in source tables as SQL CTEs (DuckDB side of the oracle).

Each constant mirrors a function of ``ledgerlens.sources.standins``.
"""

_TAX = """CASE WHEN l_tax >= 0.05 THEN (CASE WHEN l_linestatus = 'O' THEN 'INPUT' ELSE 'OUTPUT' END)
              WHEN l_linestatus = 'O' THEN 'EXEMPTEXPENSES' ELSE 'EXEMPTOUTPUT' END AS tax_type"""

INV = """inv AS (
  SELECT o_orderkey AS id, 'INV-' || CAST(o_orderkey AS VARCHAR) AS invoice_id,
         CAST(c_nationkey AS VARCHAR) AS tenant_id,
         'N' || CAST(o_orderkey AS VARCHAR) AS invoice_number, c_name AS contact_name,
         CAST(o_orderdate AS DATE) AS date, o_orderstatus AS status, o_orderpriority AS type,
         o_totalprice AS total, o_orderdate AS updated_date_utc
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

ILI = """ili AS (
  SELECT l_orderkey AS invoice_unique_id, 'INV-' || CAST(l_orderkey AS VARCHAR) AS invoice_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_item_id,
         l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no,
         l_returnflag || l_linestatus AS description, l_quantity AS quantity,
         l_extendedprice AS line_amount, l_extendedprice * l_tax AS tax_amount,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS account_code,
         CAST(l_partkey AS VARCHAR) AS item_code, l_tax AS tax_rate, """ + _TAX + """
  FROM lineitem)"""

ACC = """acc AS (
  SELECT CAST(p_size AS VARCHAR) AS code, CAST(p_partkey % 25 AS VARCHAR) AS tenant_id,
         p_name AS name, p_type AS type
  FROM part)"""

AD = """ad AS (
  SELECT code, tenant_id, name AS account_name, type AS account_type
  FROM (SELECT *, row_number() OVER (PARTITION BY code, tenant_id ORDER BY name, type) AS rn FROM acc)
  WHERE rn = 1)"""

CLAIMS = """claims AS (
  SELECT c_custkey AS id, 'EC-' || CAST(c_custkey AS VARCHAR) AS expense_claim_id,
         CAST(c_nationkey AS VARCHAR) AS tenant_id, c_mktsegment AS status, c_acctbal AS total
  FROM customer)"""

RECEIPTS = """receipts AS (
  SELECT o_orderkey AS id, o_custkey AS expense_claim_unique_id,
         'R-' || CAST(o_orderkey AS VARCHAR) AS receipt_id, CAST(o_orderdate AS DATE) AS date,
         o_orderstatus AS status, o_totalprice AS total, o_totalprice * 0.1::DOUBLE AS total_tax, o_orderpriority AS contact_name
  FROM orders)"""

RLI = """rli AS (
  SELECT l_orderkey AS receipt_unique_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_item_id,
         l_returnflag || l_linestatus AS description, l_extendedprice AS line_amount, l_tax AS tax_amount,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS account_code, """ + _TAX + """
  FROM lineitem)"""

HOLDOUT = "substr(md5(CAST({c} AS VARCHAR)), 1, 1) < '2'"

EVAL = """ev AS (
  SELECT o_orderkey AS id, CAST(c_nationkey AS VARCHAR) AS tenant_id,
         'ACCOUNT_MAPPING_VALIDATION' AS task_name, 'accrec_accpay' AS table_name,
         'INV-' || CAST(o_orderkey AS VARCHAR) AS source_id,
         o_orderpriority AS correct_target_variable, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE """ + HOLDOUT.format(c="o_orderkey") + ")"

OF = """of AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS tenant_id, 'accrec_accpay' AS table_name,
         o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, c_mktsegment, o_orderdate,
         c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


BANK = """bank AS (
  SELECT o_orderkey AS id, 'BT-' || CAST(o_orderkey AS VARCHAR) AS bank_transaction_id, CAST(c_nationkey AS VARCHAR) AS tenant_id,
         CAST(o_orderdate AS DATE) AS date, o_orderstatus AS status,
         concat_ws('-', CASE o_orderstatus WHEN 'O' THEN 'SPEND' WHEN 'F' THEN 'RECEIVE' ELSE 'TRANSFER' END, o_orderpriority) AS type,
         c_mktsegment AS bank_account_code, c_mktsegment AS bank_account_name, c_name AS contact_name, o_totalprice AS sub_total,
         o_totalprice * 0 AS total_tax, o_totalprice AS total, o_orderdate AS updated_date_utc
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_LINES = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_item_id, l_linenumber AS line_no,
         l_returnflag || l_linestatus AS description, l_quantity AS quantity, l_discount AS unit_amount, l_extendedprice AS line_amount,
         l_tax AS tax_amount, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS account_code, """ + _TAX + """
  FROM lineitem)"""

BLI = "bli AS (SELECT l_orderkey AS bank_transaction_unique_id, 'BT-' || CAST(l_orderkey AS VARCHAR) AS bank_transaction_id, " + _LINES

CREDIT = """credit AS (
  SELECT o_orderkey AS id, 'CN-' || CAST(o_orderkey AS VARCHAR) AS credit_note_id, CAST(c_nationkey AS VARCHAR) AS tenant_id,
         'C' || CAST(o_orderkey AS VARCHAR) AS credit_note_number, c_name AS contact_name, CAST(o_orderdate AS DATE) AS date,
         o_orderstatus AS status, o_orderpriority AS type, c_mktsegment AS reference, o_totalprice AS sub_total,
         o_totalprice * 0 AS total_tax, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

CLI = "cli AS (SELECT l_orderkey AS credit_note_unique_id, " + _LINES


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
