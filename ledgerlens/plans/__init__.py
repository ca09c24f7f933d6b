"""Query catalogue over the provided tables."""

from __future__ import annotations

import importlib

_MODULES = ("q_lines", "q_clean", "q_knn", "q_eval", "q_text", "q_select", "q_registry", "q_steps", "q_versions", "q_checks", "q_answers", "q_tax")


def load_all():
    """Import every catalogue module; returns (queries, oracles)."""
    for m in _MODULES:
        importlib.import_module(f"ledgerlens.plans.{m}")
    from ledgerlens.plans.catalog import ORACLES, QUERIES
    return QUERIES, ORACLES
