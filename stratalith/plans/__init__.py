"""Registered queries of the core and their SQL."""

from __future__ import annotations

from stratalith.plans import cdc, retrieval, state

MODULES = [cdc, retrieval, state]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
