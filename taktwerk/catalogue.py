"""All queries of the flow-analytics operators and their DuckDB SQL."""

from __future__ import annotations

from taktwerk.plans import decisions, evaluation, evidence, flow, frozen, inference, methods, observe, quality, risk, streams, texts
from taktwerk.plans.base import Query

MODULES = (flow, inference, quality, decisions, evaluation, risk, observe, methods, streams, frozen, texts, evidence)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
