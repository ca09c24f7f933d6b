"""Line tables: header + line + chart-of-accounts -> one flat line table.

Covers S2 (named plans), P1-P4 (tenant / date predicates, renaming, type CASE),
J1-J5 (header joins, three-way chain, account dimension), W1 (first line per
header) and W3 (one account per (code, tenant)).

All plans are declarative; Catalyst pushes tenant/date predicates into the
header scan and the tenant literal through the left-join key into the
account-dimension scan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import discard, materialize
from ledgerlens.sources.tables import date_range

# ---- fixed values: bank transaction type rule (first match wins) ----------
BANK_TYPE_RULES = (("%SPEND%", "CASHPAID"), ("%RECEIVE%", "CASHREC"))
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class LinePlan:
    """How one journal source becomes a line table."""

    table_name: str
    header_key: str                 # header surrogate key (e.g. invoices.id)
    line_fk: str                    # line column referencing header_key
    header_id: str                  # line-side header id for first-line partition
    line_order: tuple[str, ...]     # total order of lines inside a header
    date_col: str                   # header date -> journal_date
    range_col: str | None = None    # header column for the date range (default date_col)
    type_col: str | None = None     # header type column -> source_type
    type_rules: tuple[tuple[str, str], ...] = ()
    code_col: str = "account_code"  # line column joined to the account dimension
    header_cols: tuple[str, ...] = ()   # header columns carried to the output
    line_cols: tuple[str, ...] = ()     # line columns carried to the output


def source_type_case(col: str | Column, rules=BANK_TYPE_RULES) -> Column:
    """``CASE WHEN c LIKE p1 THEN l1 WHEN c LIKE p2 THEN l2 ELSE c END``."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for pattern, label in rules:
        out = (F.when(c.like(pattern), F.lit(label)) if out is None
               else out.when(c.like(pattern), F.lit(label)))
    return c if out is None else out.otherwise(c)


def first_per(df: DataFrame, partition: list[str] | tuple[str, ...],
              order: list[str | Column] | tuple) -> DataFrame:
    """Keep the first row per partition in the given order.

    ``row_number() = 1`` is planned as a partial WindowGroupLimit before the
    shuffle, so each map task ships at most one row per key.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def account_details(accounts: DataFrame) -> DataFrame:
    """``DISTINCT ON (code, tenant_id) ... ORDER BY code, tenant_id, name``.

    ``type`` is added as a tie-break so the pick is deterministic.
    """
    one = first_per(accounts, ["code", "tenant_id"], [F.col("name").asc_nulls_last(),
                                                       F.col("type").asc_nulls_last()])
    return one.select(F.col("code").alias("_ad_code"), F.col("tenant_id").alias("_ad_tenant"),
                      F.col("name").alias("account_name"), F.col("type").alias("account_type"))


def with_accounts(lines: DataFrame, accounts: DataFrame, code_col: str = "account_code",
                  tenant_col: str = "tenant_id") -> DataFrame:
    """Line LEFT JOIN one-account-per-key dimension on (code, tenant)."""
    ad = account_details(accounts)
    return (lines.join(ad, (F.col(code_col) == F.col("_ad_code")) &
                       (F.col(tenant_col) == F.col("_ad_tenant")), "left")
                 .drop("_ad_code", "_ad_tenant"))


def filter_headers(headers: DataFrame, plan: LinePlan, tenant=None, start=None, end=None) -> DataFrame:
    """P1 + P2 on the header side (pushed into the header scan)."""
    h = headers
    if tenant is not None:
        h = h.filter(F.col("tenant_id") == F.lit(tenant))
    return date_range(h, plan.range_col or plan.date_col, start, end)


def join_headers(lines: DataFrame, headers: DataFrame, plan: LinePlan) -> DataFrame:
    """Line JOIN header on the header surrogate key (inner)."""
    hcols = [plan.header_key, "tenant_id", plan.date_col] + list(plan.header_cols)
    if plan.type_col:
        hcols.append(plan.type_col)
    h = headers.select(*[F.col(c).alias(f"_h_{c}") for c in dict.fromkeys(hcols)])
    return lines.join(h, F.col(plan.line_fk) == F.col(f"_h_{plan.header_key}"), "inner")


def build_lines(headers: DataFrame, lines: DataFrame, accounts: DataFrame | None, plan: LinePlan,
                *, tenant=None, start=None, end=None, first_only: bool = True) -> DataFrame:
    """A named line query: filter headers, join lines, accounts, first line, project."""
    h = filter_headers(headers, plan, tenant, start, end)
    return _finished(join_headers(lines, h, plan).withColumnRenamed("_h_tenant_id", "tenant_id"), accounts, plan, first_only)


def _finished(j: DataFrame, accounts: DataFrame | None, plan: LinePlan, first_only: bool) -> DataFrame:
    if accounts is not None:
        j = with_accounts(j, accounts, plan.code_col)
    if first_only:
        j = first_per(j, ["tenant_id", plan.header_id], [F.col(c) for c in plan.line_order])  # ids are a tenant's own
    out = [F.lit(plan.table_name).alias("table_name"), F.col("tenant_id")]
    out += [F.col(c) for c in plan.line_cols]
    out += [F.col(f"_h_{c}").alias(c) for c in plan.header_cols]
    if accounts is not None:
        out += [F.col("account_name"), F.col("account_type")]
    if plan.type_col:
        out.append(source_type_case(F.col(f"_h_{plan.type_col}"), plan.type_rules).alias("source_type"))
    out.append(F.col(f"_h_{plan.date_col}").alias("journal_date"))
    return j.select(*out)


def written_first_lines(headers: DataFrame, lines: DataFrame, accounts: DataFrame | None, plan: LinePlan, columns) -> DataFrame:
    """``columns`` of ``build_lines``, written: for first lines that several steps read.

    The first lines of each key are taken where the join has dealt them and written, so the shuffles
    of the join are gone before these lines move to their tenant and header id.
    """
    columns = list(dict.fromkeys(columns))
    plan = replace(plan, line_cols=tuple(c for c in plan.line_cols if c in columns), header_cols=tuple(c for c in plan.header_cols if c in columns))
    j = join_headers(lines, headers, plan).withColumnRenamed("_h_tenant_id", "tenant_id")
    needed = {plan.line_fk, plan.header_id, plan.code_col, "tenant_id", *plan.line_order, *plan.line_cols}
    order = [F.col(c) for c in plan.line_order]
    first = first_per(j.select(*[c for c in j.columns if c in needed or c.startswith("_h_")]), [plan.line_fk, "tenant_id", plan.header_id], order)
    joined = materialize(first, "joined_lines")
    out = materialize(_finished(joined, accounts, plan, True).select(*columns), "first_lines")
    discard(joined)
    return out


def build_chain(claims: DataFrame, receipts: DataFrame, receipt_lines: DataFrame,
                accounts: DataFrame | None, *, claim_key: str, receipt_fk: str,
                receipt_key: str, line_fk: str, claim_cols: tuple[str, ...],
                receipt_cols: tuple[str, ...], line_cols: tuple[str, ...],
                table_name: str = "expclaim", range_col: str | None = None,
                tenant=None, start=None, end=None, first_only: bool = False,
                receipt_id: str | None = None, line_order: tuple[str, ...] = ()) -> DataFrame:
    """Claim JOIN receipt JOIN receipt line (two inner equi-joins)."""
    c = claims
    if tenant is not None:
        c = c.filter(F.col("tenant_id") == F.lit(tenant))
    if range_col:
        c = date_range(c, range_col, start, end)
    c = c.select(F.col(claim_key).alias("_c_key"), F.col("tenant_id"),
                 *[F.col(x).alias(f"claim_{x}") for x in claim_cols])
    r = receipts.select(F.col(receipt_key).alias("_r_key"), F.col(receipt_fk).alias("_r_fk"),
                        *[F.col(x).alias(f"receipt_{x}") for x in receipt_cols])
    j = (receipt_lines.join(r, F.col(line_fk) == F.col("_r_key"), "inner")
                      .join(c, F.col("_r_fk") == F.col("_c_key"), "inner"))
    if accounts is not None:
        j = with_accounts(j, accounts)
    if first_only and receipt_id:
        j = first_per(j, ["tenant_id", receipt_id], [F.col(x) for x in line_order])
    out = [F.lit(table_name).alias("table_name"), F.col("tenant_id")]
    out += [F.col(x) for x in line_cols]
    out += [F.col(f"receipt_{x}") for x in receipt_cols]
    out += [F.col(f"claim_{x}") for x in claim_cols]
    if accounts is not None:
        out += [F.col("account_name"), F.col("account_type")]
    return j.select(*out)


def line_counts(lines: DataFrame, keys=("table_name", "tenant_id")) -> DataFrame:
    """Number of lines per (table, tenant) from the same plan as the data."""
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
