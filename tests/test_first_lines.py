"""First lines that are written for several steps are those of the lazy plan, and the join is not kept."""

from __future__ import annotations

import os

from ledgerlens.session import scratch_path
from ledgerlens.sources import line_tables as lt
from ledgerlens.sources import standins as si



def test_written_first_lines_are_the_first_lines(spark):
    """Two keys with one header id, two header ids under one key, an id that two tenants have, a line without a header."""
    headers = spark.createDataFrame([(1, "I1", "A", "n"), (2, "I1", "A", "m"), (3, "I2", "B", "n"), (4, "I1", "B", "o")], "id long, invoice_id string, tenant_id string, contact_name string") \
        .selectExpr("*", "invoice_id invoice_number", "date'2024-01-01' date", "'x' type", "1.0 total", "timestamp'2024-01-01' updated_date_utc")
    rows = [(1, "I1", 2, "b"), (1, "I9", 5, "c"), (2, "I1", 1, "a"), (3, "I2", 1, "d"), (3, "I2", 2, "e"), (4, "I1", 3, "f"), (4, None, 4, "g"), (9, "I9", 1, "h")]
    lines = spark.createDataFrame(rows, "invoice_unique_id long, invoice_id string, line_no int, line_item_id string") \
        .selectExpr("*", "1 part_no", "1 supp_no", "'t' description", "1.0 quantity", "2.0 line_amount", "0.5 tax_amount", "cast(line_no as string) account_code", "'i' item_code")
    accounts = spark.createDataFrame([("1", "A", "Sales", "x"), ("1", "A", "Rent", "y"), ("3", "B", "Fees", "x")], "code string, tenant_id string, name string, type string")
    columns = ["table_name", "tenant_id", "line_item_id", "account_code", "account_name", "contact_name", "source_type", "journal_date"]
    base = os.path.dirname(scratch_path(spark, "x").removeprefix("file:"))
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    got = lt.written_first_lines(headers, lines, accounts, si.INVOICE_PLAN, columns)
    want = lt.build_lines(headers, lines, accounts, si.INVOICE_PLAN).select(*columns)
    assert got.columns == columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(r.line_item_id for r in got.collect()) == ["a", "c", "d", "f", "g"]
    assert sorted(x.split("-")[0] for x in set(os.listdir(base)) - before) == ["first_lines"]
