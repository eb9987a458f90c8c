"""Named checks: a Spark query and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, list]] = {}
#: SQL twins of the adapters, by view name.
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(body: str, extra: list[tuple[str, str]] | None = None, materialized: bool = True) -> str:
    """Prefix ``body`` with the views it mentions (directly or through other views)."""
    chain = list(extra or [])
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    for _, text in chain:
        visit(text)
    visit(body)
    ctes = [(n, VIEWS[n]) for n in needed] + chain
    if not ctes:
        return body.strip()
    word = "MATERIALIZED " if materialized else ""
    return "WITH " + ",\n".join(f"{n} AS {word}({t})" for n, t in ctes) + "\n" + body.strip()


def check(name: str, sql: str | None = None, extra: list[tuple[str, str]] | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (sql, extra or [])
        return fn

    return register


def oracle() -> dict[str, str]:
    """The SQL twins, complete with the views they use."""
    return {name: with_views(sql, extra) for name, (sql, extra) in _SQL.items()}
