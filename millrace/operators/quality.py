"""Data-quality checks as rows: name, observed, expected, passed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F


def existence(df: DataFrame) -> DataFrame:
    """Row count and a status label."""
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "status", F.when(F.col("row_count") > 0, "has_data").otherwise("no_data"))


def duplicates(column: str) -> Column:
    """Rows minus distinct values."""
    return F.count("*") - F.countDistinct(column)


def violations(condition: Column) -> Column:
    """Rows for which the condition holds."""
    return F.count_if(condition)


def run_checks(df: DataFrame, checks: Mapping[str, Column], expected: int = 0) -> DataFrame:
    """All checks of one table in one aggregate pass, one result row per check."""
    names = list(checks)
    row = df.agg(*[checks[n].cast("long").alias(f"c{i}") for i, n in enumerate(names)])
    cells = [F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("observed"))
             for i, n in enumerate(names)]
    return _judged(row.select(F.inline(F.array(*cells))), expected)


def watched(df: DataFrame, checks: Mapping[str, Column], expected: int = 0
            ) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The rows, and the checks on them to be read once the rows have been written.

    The checks run in the pass that writes, so nothing is read for them. They
    may not count distinct values, which that pass cannot.
    """
    names, seen = list(checks), Observation()
    rows = df.observe(seen, *[checks[n].cast("long").alias(f"c{i}") for i, n in enumerate(names)])

    def results() -> DataFrame:
        found = [(n, seen.get[f"c{i}"]) for i, n in enumerate(names)]
        return _judged(df.sparkSession.createDataFrame(found, "check_name STRING, observed BIGINT"), expected)

    return rows, results


def referential_check(name: str, children: DataFrame, parents: DataFrame, child_key: str,
                      parent_key: str, expected: int = 0) -> DataFrame:
    """Children without a parent, counted.

    Children are counted per key before the anti join, so a hot key is one row.
    """
    keys = children.groupBy(child_key).agg(F.count("*").alias("_n"))
    lost = keys.join(parents, keys[child_key] == parents[parent_key], "left_anti")
    return _judged(lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("observed")).select(
        F.lit(name).alias("check_name"), "observed"), expected)


def suite(*results: DataFrame) -> DataFrame:
    """Results of several tables as one table."""
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def score(results: DataFrame, threshold: float = 95.0) -> DataFrame:
    """Share of passed checks in percent, and whether it is below the alert threshold."""
    row = results.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    return row.withColumn("score", F.col("passed") * 100.0 / F.col("total")).withColumn(
        "alert", F.col("score") < threshold)


def _judged(df: DataFrame, expected: int) -> DataFrame:
    return df.withColumn("expected", F.lit(expected).cast("long")).withColumn(
        "passed", F.col("observed") == F.col("expected"))
