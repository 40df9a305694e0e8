"""Named queries over the test tables: each module registers builders and DuckDB oracles in ``registry``."""

import importlib
import warnings

from tessera.plans.registry import BENCH, ORACLES, QUERIES, oracle_texts


def load_all() -> dict[str, str]:
    """Import every plan module so its queries register. A module that cannot be imported loses its own queries
    only; its error is warned about and returned by module name."""
    failed: dict[str, str] = {}
    for m in PLAN_MODULES:
        try:
            importlib.import_module(f"tessera.plans.{m}")
        except Exception as exc:  # noqa: BLE001 - reported, and the other modules still count
            failed[m] = repr(exc)
            warnings.warn(f"queries of tessera.plans.{m} are missing: {exc!r}", stacklevel=2)
    return failed


PLAN_MODULES = ["dashboards", "reconciliation", "intake", "fields", "operations", "quality", "retrieval", "streams"]

__all__ = ["BENCH", "ORACLES", "QUERIES", "load_all", "oracle_texts"]
