"""Names of the queries, their builders and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


for _name in ("catalog", "cleaning", "chunking", "pairing", "reporting", "prompting", "exchange", "assembly"):
    import_module(f"corpusloom.plans.{_name}")
