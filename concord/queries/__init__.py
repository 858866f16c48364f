"""Registered queries by section."""

import importlib

from concord.queries.registry import ORACLES, QUERIES

SECTIONS = (
    "a_sources", "b_compare", "c_sweep", "d_normalise", "e_validate", "f_reserved",
    "g_rings", "h_ledger", "i_rules", "j_versions", "k_scan", "l_rollup", "m_plans",
)

for section in SECTIONS:
    importlib.import_module(f"concord.queries.{section}")

__all__ = ["ORACLES", "QUERIES"]
