"""All oracle SQL strings (DuckDB dialect), fixture views inlined."""

from __future__ import annotations

from mercata.plans.oracle_base import with_fixtures
from mercata.plans import oracle_customers, oracle_delivery, oracle_experiment, oracle_growth, oracle_ingest, oracle_scorecard


def oracle_sql() -> dict[str, str]:
    raw: dict[str, str] = {}
    for module in (oracle_growth, oracle_delivery, oracle_customers, oracle_experiment, oracle_scorecard, oracle_ingest):
        raw.update(module.ORACLES)
    return {name: with_fixtures(sql) for name, sql in raw.items()}
