"""Named queries with their independent SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfledger.plans import carriers as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
PARTS = {"obs": C.OBS_SQL, "cat": C.CAT_SQL, "runs": C.RUN_SQL}


def check(sql: str, *parts: str) -> str:
    """Prefix the carrier definitions a check needs; ``sql`` may add its own ``name AS (...),`` definitions first."""
    body = sql.strip()
    defs = ",\n".join(PARTS[p] for p in parts)
    if not defs:
        return body
    if body.lower().startswith("with "):
        return f"WITH {defs},\n{body[5:]}"
    return f"WITH {defs}\n{body}"


def query(name: str, sql: str | None = None, *parts: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql:
            CHECKS[name] = check(sql, *parts)
        return function
    return register
