"""All queries of the core library and the SQL that each must equal."""

from __future__ import annotations

from codeweft.plans import code, graphs, problems, quality

PARTS = (problems, graphs, quality, code)


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.ORACLE.items()}
