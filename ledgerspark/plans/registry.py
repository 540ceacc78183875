"""Where a query and its SQL are put side by side."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.adapter import LOANS_SQL, RAW_ACCEPTED_SQL, RAW_REJECTED_SQL, REJECTED_SQL

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
#: Names that a query's SQL may use as tables.
PARTS = {"loans": LOANS_SQL, "rejected": REJECTED_SQL, "raw_accepted": RAW_ACCEPTED_SQL, "raw_rejected": RAW_REJECTED_SQL}
T = 0.35


def query(name: str, sql: str | None = None, *uses: str, more: str = "") -> Callable:
    """Registers a function of (spark, sf_dir). uses: the parts its SQL needs; more: further common table expressions."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            parts = [PARTS[u] for u in uses] + ([more] if more else [])
            ORACLE_SQL[name] = ("WITH " + ",".join(parts) if parts else "") + "\n" + sql
        return f

    return put
