"""Registry of named queries with the SQL that recomputes each result independently."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(v)``; ``v`` gives the derived views of one data folder as DataFrames."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(views.Views(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the view definitions it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views.SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(views.SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS (\n{views.SQL[n].strip()}\n)" for n in needed)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"
