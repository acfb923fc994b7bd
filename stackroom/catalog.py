"""Registry of the library queries: name -> (function, SQL for the same rows)."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from .plans import conditions, facade, increments, scalars, tables, vectors  # noqa: F401  they register


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)


def flagship(spark, sf_dir: str):
    """Several conditions on documents without the trash, longest first, 20 rows."""
    from .plans.conditions import adv_all

    return adv_all(spark, sf_dir)
