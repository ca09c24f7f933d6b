"""ledgerlens: ledger-line classification and audit on Spark.

Every public operator takes and returns DataFrames.  Work is grouped by
``(tenant_id, table_name)`` so one job serves all tenants and tables.
"""

from ledgerlens.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
