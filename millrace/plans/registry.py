"""Registration of named queries together with the SQL that checks them.

``columns`` names the result columns and their plain types. Both the Spark
result and the checking SQL are cast to them, so that two engines with
different decimal and date types can be compared value by value.

    str   text (dates become yyyy-MM-dd)      long  64-bit integer
    ts    timestamp as yyyy-MM-dd HH:mm:ss    bool  boolean
    dbl   double                              dblN  double rounded to N places

``dblN`` is for means of doubles, whose last digits depend on the order of
summation. It adds a small fraction of the last place before rounding, so that
an exact half rounds up in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


class QuerySet:
    def __init__(self) -> None:
        self.spark: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, columns: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        spec = [tuple(part.split()) for part in columns.split(",")]

        def register(fn: QueryFn) -> QueryFn:
            if name in self.spark:
                raise ValueError(f"query {name} is registered twice")
            self.spark[name] = lambda spark, sf_dir: fn(spark, sf_dir).select(
                *[_spark_cast(c, t).alias(c) for c, t in spec])
            if sql is not None:
                listed = ", ".join(f"{_sql_cast(c, t)} AS {c}" for c, t in spec)
                self.sql[name] = f"SELECT {listed} FROM ({sql.strip()}) AS q"
            return fn

        return register


def _spark_cast(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "ts":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if kind.startswith("dbl"):
        c = c.cast("double")
        return F.round(c + F.lit(_nudge(kind)), int(kind[3:])) + F.lit(0.0) if kind != "dbl" else c
    return c.cast({"str": "string", "long": "long", "bool": "boolean"}[kind])


def _sql_cast(name: str, kind: str) -> str:
    if kind == "ts":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    if kind.startswith("dbl"):
        cast = f"CAST({name} AS DOUBLE)"
        if kind == "dbl":
            return cast
        return f"round({cast} + {_nudge(kind)!r}::DOUBLE, {int(kind[3:])}) + 0.0::DOUBLE"
    return f"CAST({name} AS {dict(str='VARCHAR', long='BIGINT', bool='BOOLEAN')[kind]})"


def _nudge(kind: str) -> float:
    return 1.37 * 10.0 ** -(int(kind[3:]) + 3)
