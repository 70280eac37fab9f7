"""Registered queries: functions over scene views, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from skein.views import frame, with_

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(function):
        name = function.__name__

        def run(spark, sf_dir, function=function) -> DataFrame:
            known: dict[str, DataFrame] = {}
            return function(lambda view: frame(spark, sf_dir, view, known))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_(sql)
        return function

    return add
