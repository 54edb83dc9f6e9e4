"""Queries over the driver's tables; importing a module registers its queries."""

from __future__ import annotations

from importlib import import_module

from corrobora.plans.registry import ORACLES, QUERIES, Query

MODULES = ("counts", "evidence", "context", "contracts", "sumstats", "intervals", "resampling", "graph", "model", "summary")


def _load() -> None:
    for name in MODULES:
        import_module(f"corrobora.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
