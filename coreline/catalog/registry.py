"""Registered queries, each with the columns and digits it reports.

A column list such as ``"site av:4 n:i"`` is applied to the Spark result and to
the SQL twin alike: ``:4`` rounds to four digits, ``:i`` is a 64-bit integer, a
bare name passes through.  ``:6~`` goes by way of ten exact decimals, so that a
tie is a tie in either engine, whatever the order of its sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreline.catalog.sql_views import with_views
from coreline.sources.driver_tables import DriverSurvey

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple((item + ":").split(":")[:2]) for item in spec.split()]


def _report(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        if kind == "i":
            out.append(F.col(name).cast("bigint").alias(name))
        elif kind:
            value = F.col(name).cast("decimal(38,10)" if kind.endswith("~") else "double")
            out.append(F.round(value, int(kind.rstrip("~"))).cast("double").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def _report_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind:
            exact = "DECIMAL(38, 10)" if kind.endswith("~") else "DOUBLE"
            out.append(f"CAST(round(CAST({name} AS {exact}), {kind.rstrip('~')}) AS DOUBLE) AS {name}")
        else:
            out.append(name)
    return with_views(f"SELECT {', '.join(out)} FROM ({sql}) AS result")


def query(spec: str, sql: str | None = None, name: str | None = None):
    """Register a function of a survey under its own name.

    The function itself works on any :class:`FieldSurvey`.
    """
    def add(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _report(fn(DriverSurvey(spark, folder)), spec)

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = _report_sql(sql, spec)
        return fn

    return add
