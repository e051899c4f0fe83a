"""Registration of a query: an operator over named views, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.bindings import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str, sql: str | None = None, needs: str | None = None):
    """Register the function, which is called with the views in order; sql may use them and those in needs by name."""
    names = views.split()

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in names])
        if sql is not None:
            head = ctes(*(names if needs is None else needs.split()))
            body = sql.strip()
            if head and body.upper().startswith("WITH RECURSIVE "):
                body = ", " + body[len("WITH RECURSIVE ") :]
            elif head and body.upper().startswith("WITH "):
                body = ", " + body[len("WITH ") :]
            ORACLES[f.__name__] = f"{head}{body if body.startswith(',') else ' ' + body}"
        return f

    return register
