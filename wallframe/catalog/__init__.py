"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from ..session import prepare

MODULES = (
    "geometry_queries",
    "evaluation_queries",
    "grouping_queries",
    "pixel_queries",
    "dataset_queries",
)


def _prepared(fn):
    @wraps(fn)
    def run(spark, sf):
        return fn(prepare(spark), sf)

    return run


def collect() -> tuple[dict, dict[str, str]]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries.update({key: _prepared(fn) for key, fn in module.Q.items()})
        sql.update(module.SQL)
    return queries, sql
