"""All registered queries of the market operators with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_core", "q_series", "q_value", "q_reads", "q_tables", "q_runs", "q_streams")
QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    _q = import_module(f"marketlake.plans.{_m}")
    QUERIES.update(_q.QUERIES)
    ORACLES.update(_q.ORACLES)
FLAGSHIP = "o065_bucket_rollup_quotes"
