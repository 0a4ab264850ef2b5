"""Registration of queries: a DataFrame function over named tables and its SQL twin."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

from folioquery.plans.ship import ship
from folioquery.sources.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, python: bool = False):
    """Register ``f(read)``; read(name) is a table of the folder asked for.

    python: the plan runs functions of this package on executors.
    """

    def made(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        @wraps(f)
        def run(spark, folder):
            if python:
                ship(spark)
            return f(lambda t: table(spark, folder, t))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return made
