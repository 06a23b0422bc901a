"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a (spark, folder) function under its name; ``sql`` gives the same rows in DuckDB."""
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


from . import chat, curation, evaluation, metrics, models, packing, sampling, scans, webdocs  # noqa: E402,F401  they register themselves
