"""Named queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlens.adapters import TABLES, VIEWS, Data, placeholders

QUERIES: dict[str, Callable[[Data], DataFrame]] = {}
CHECKS: dict[str, str] = {}
SHARED: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def register(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def shared(name: str, sql: str) -> None:
    """A common table expression that several checks use."""
    SHARED[name] = sql


def _known(name: str) -> str | None:
    return SHARED.get(name) or VIEWS.get(name)


def _needed(sql: str, found: dict[str, str]) -> None:
    for name in placeholders(sql):
        if name in TABLES or name in found:
            continue
        text = _known(name)
        if text is None:
            raise KeyError(f"unknown view {name}")
        _needed(text, found)
        found[name] = text


def check_sql(name: str) -> str:
    """The check of a query as one statement with the views it needs."""
    body = CHECKS[name].strip()
    found: dict[str, str] = {}
    _needed(body, found)
    parts = [f"{view} as ({text.strip()})" for view, text in found.items()]
    own = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if own:
        body = body[own.end():]
        head = "with recursive " + ", ".join(parts) + (", " if parts else "")
    else:
        head = ("with " + ", ".join(parts) + " ") if parts else ""
    return re.sub(r"\{([a-z]\w*)\}", r"\1", head + body)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Data(spark, sf_dir))

    run.__name__ = name
    return run
