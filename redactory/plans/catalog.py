"""The registered queries and their SQL."""

from __future__ import annotations

from redactory.plans import detection, exchange, extraction, files, governed, intake, kept, lifecycle, models, quality, records, streams, tools

MODULES = (detection, exchange, extraction, files, governed, intake, kept, lifecycle, models, quality, records, streams, tools)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
