"""Declaring a query: the function, and beside it the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from stratacube.operators.stats import rounded_columns


def registrar(queries: dict, oracle: dict) -> Callable:
    """``@query(sql)`` registers a function of (spark, sf_dir) under its own name; doubles are compared at six decimals."""

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = lambda spark, sf_dir: rounded_columns(f(spark, sf_dir))
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return register

    return query
