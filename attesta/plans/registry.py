"""A small decorator that pairs a Spark query with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

# DuckDB text of functions.numeric.draw; {0} is the already joined key expression.
DUCK_DRAW = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


def registrar() -> tuple[dict, Callable]:
    found: dict = {}

    def query(sql: str | None = None, name: str | None = None):
        def wrap(fn):
            found[name or fn.__name__] = (fn, sql)
            return fn

        return wrap

    return found, query
