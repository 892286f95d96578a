"""All queries of the library by name, with their SQL. A query is a function (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
MODULES = ("aggregates", "texts", "series", "rules", "joins", "consensus", "networks", "searches", "streams", "extraction", "records", "measures", "boards", "choices", "feeds", "notes", "assembly")


def query(sql: str | None = None):
    """Registers a function under its name, with the DuckDB SQL of the same result where SQL can express it."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidewire.plans.{m}")


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_SQL)


def flagship(spark, sf_dir):
    """The day's digest: totals and tone per entity and day."""
    return queries()["by_person_day"](spark, sf_dir)
