"""Driver contract: entry() runs on sf0.001 and every oracle has a query."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_catalogue_consistent():
    m = load_entry()
    q, o = m.queries(), m.oracle_sql()
    assert len(q) >= 60
    assert set(o) <= set(q)


def test_entry_runs(spark):
    m = load_entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert {"tenant_id", "q_id", "prediction", "booked", "class_frequency"} <= set(df.columns)
