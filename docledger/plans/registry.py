"""Registered queries and their SQL, by name."""

from __future__ import annotations

from docledger.plans.oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None):
    """Register a query under its function's name, with SQL over the entities of docledger.plans.oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return register
