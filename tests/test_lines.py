"""Line-table plans on hand-made edge rows (FIXTURES.md §4 'first line' and 'dates')."""

import datetime as dt

from ledgerlens.operators import lookup
from ledgerlens.sources import line_tables as lt
from ledgerlens.sources import tables

PLAN = lt.LinePlan(table_name="accrec_accpay", header_key="id", line_fk="hid", header_id="hname",
                   line_order=("line_id",), date_col="date", type_col="type", type_rules=lt.BANK_TYPE_RULES,
                   header_cols=("hname",), line_cols=("line_id", "account_code"))


def frames(spark):
    headers = spark.createDataFrame([
        (1, "H1", "t1", dt.date(2024, 1, 1), "SPEND RECEIVE"),
        (2, "H2", "t1", dt.date(2024, 1, 31), "RECEIVE"),     # no lines
        (3, "H3", "t2", dt.date(2024, 2, 1), "OTHER"),
    ], "id long, hname string, tenant_id string, date date, type string")
    lines = spark.createDataFrame([
        (1, "H1", 30, "200"), (1, "H1", 10, "400"), (1, "H1", 20, "200"),   # out of id order
        (3, "H3", 5, "999"),                                               # code missing in dimension
        (9, "H9", 1, "200"),                                               # line without header
    ], "hid long, hname string, line_id long, account_code string")
    accounts = spark.createDataFrame([
        ("400", "t1", "Sales", "REV"), ("400", "t1", "Income", "REV"),      # two names: smallest wins
        ("200", "t1", "Bank", "ASSET"), ("400", "t2", "Other tenant", "REV"),
    ], "code string, tenant_id string, name string, type string")
    return headers, lines, accounts


def test_first_line_with_accounts(spark):
    h, l, a = frames(spark)
    rows = {r["hname"]: r for r in lt.build_lines(h, l, a, PLAN).collect()}
    assert set(rows) == {"H1", "H3"}
    assert rows["H1"]["line_id"] == 10 and rows["H1"]["account_name"] == "Income"
    assert rows["H1"]["source_type"] == "CASHPAID"          # first matching rule wins
    assert rows["H3"]["account_name"] is None and rows["H3"]["source_type"] == "OTHER"


def test_all_lines_and_inclusive_range(spark):
    h, l, a = frames(spark)
    assert lt.build_lines(h, l, None, PLAN, first_only=False).count() == 4
    rng = lt.build_lines(h, l, None, PLAN, start="2024-01-01", end="2024-01-31", first_only=False)
    assert sorted(r["line_id"] for r in rng.collect()) == [10, 20, 30]
    only_t2 = lt.build_lines(h, l, a, PLAN, tenant="t2")
    assert [r["hname"] for r in only_t2.collect()] == ["H3"]


def test_counts_share_the_data_plan(spark):
    h, l, _ = frames(spark)
    c = {(r["table_name"], r["tenant_id"]): r["n_lines"] for r in lt.line_counts(lt.build_lines(h, l, None, PLAN)).collect()}
    assert c == {("accrec_accpay", "t1"): 1, ("accrec_accpay", "t2"): 1}


def test_tenants_and_lookups(spark):
    h, l, _ = frames(spark)
    assert sorted(r[0] for r in tables.tenants(h, "t2").collect()) == ["t2"]
    assert sorted(r[0] for r in tables.tenants(h, "nope").collect()) == ["t1", "t2"]
    ids = spark.createDataFrame([("H1",), ("H2",)], "hname string")
    lines = lt.build_lines(h, l, None, PLAN)
    assert [r["hname"] for r in lookup.lookup_ids(lines, ids, "hname").collect()] == ["H1"]
    assert [r["hname"] for r in lookup.missing_ids(ids, lines, "hname").collect()] == ["H2"]
