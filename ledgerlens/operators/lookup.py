"""Id lookups and hold-out removal.

Id lists are always DataFrames joined with semi/anti joins -- never a literal
IN-list collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def lookup_ids(lines: DataFrame, ids: DataFrame, on, ids_on=None) -> DataFrame:
    """Lines whose key occurs in ``ids`` (LEFT SEMI)."""
    on, ids_on = _keys(on), _keys(ids_on or on)
    probe = ids.select(*[F.col(b).alias(a) for a, b in zip(on, ids_on)])
    return lines.join(probe, on, "left_semi")


def missing_ids(ids: DataFrame, lines: DataFrame, on, lines_on=None) -> DataFrame:
    """Ids that have no line (LEFT ANTI)."""
    on, lines_on = _keys(on), _keys(lines_on or on)
    probe = lines.select(*[F.col(b).alias(a) for a, b in zip(on, lines_on)])
    return ids.join(probe, on, "left_anti")


def remove_holdout(train: DataFrame, eval_set: DataFrame,
                   keys=("tenant_id", "table_name", "line_item_id"), eval_keys=None) -> DataFrame:
    """Training lines not in the evaluation set of the same (tenant, table)."""
    return missing_ids(train, eval_set, list(keys), list(eval_keys or keys))


def eval_slice(eval_set: DataFrame, task_name: str, tenant=None, table_name=None) -> DataFrame:
    """Compound equality filter (task, tenant, table) on the evaluation set."""
    out = eval_set.filter(F.col("task_name") == F.lit(task_name))
    if tenant is not None:
        out = out.filter(F.col("tenant_id") == F.lit(tenant))
    if table_name is not None:
        out = out.filter(F.col("table_name") == F.lit(table_name))
    return out
