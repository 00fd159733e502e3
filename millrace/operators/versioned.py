"""Versions of a table as frames: evolution, upsert, delete, diff, time travel, rollback.

The first part works on states: frames with one row per key. The second part
works on a change log, an ordinary frame of change rows: the table's columns,
``_op`` ('put' or 'delete') and ``_version``. Nothing here stores anything; on
a catalog with a table format, its own ``MERGE`` and ``VERSION AS OF`` serve.
A null key matches no other, as in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# States --------------------------------------------------------------------------------------


def evolve(*parts: DataFrame) -> DataFrame:
    """One frame of parts with different columns; a row without a column reads NULL there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Read through a name map, so a rename touches no stored file."""
    return df.withColumnsRenamed(dict(names))


def delete_where(state: DataFrame, condition: Column) -> DataFrame:
    """The state without the rows a condition selects; a row for which it is unknown stays."""
    return state.filter(~F.coalesce(condition, F.lit(False)))


def _single(source: DataFrame, key: str, updated: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The source as (key, _s), where a repeated key is an error, and its other columns."""
    fields = [c for c in source.columns if c != key]
    absent = sorted(set(updated) - set(fields))
    if absent:
        raise ValueError(f"updated columns that the source lacks: {absent}")
    rows = source.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(F.struct(*fields)).alias("_s"))
    repeated = F.raise_error(F.concat(F.lit("duplicate merge key "), F.coalesce(
        F.col(key).cast("string"), F.lit("NULL"))))
    return rows.select(key, F.when(F.col("_n") > 1, repeated).otherwise(F.col("_s")).alias("_s")), fields


def _merged(current: DataFrame, source: DataFrame, key: str, updated: Sequence[str],
            how: str) -> DataFrame:
    single, fields = _single(source, key, updated)
    joined = current.withColumn("_hit", F.lit(True)).join(single, key, how)

    def value(name):
        own = F.col(f"_s.{name}") if name in fields else F.lit(None)
        if name not in current.columns:
            return own.alias(name)
        if name in updated:
            return F.when(F.col("_s").isNotNull(), own).otherwise(F.col(name)).alias(name)
        return F.when(F.col("_hit"), F.col(name)).otherwise(own).alias(name)

    names = [c for c in current.columns if c != key] + [c for c in fields if c not in current.columns]
    return joined.select(key, *[value(c) for c in names])


def upsert(current: DataFrame, source: DataFrame, key: str, updated: Sequence[str]) -> DataFrame:
    """The state after an upsert: matched keys take the ``updated`` columns, others are inserted.

    One outer join. A key that occurs twice in the source is an error, raised
    where it is found, and so is an updated column that the source lacks.
    """
    return _merged(current, source, key, updated, "full")


def merge_rows(current: DataFrame, source: DataFrame, key: str, updated: Sequence[str]) -> DataFrame:
    """Only the rows an upsert writes; the current rows of other keys leave before the join."""
    touched = current.join(source.select(key), key, "left_semi")
    return _merged(touched, source, key, updated, "full")


def _paired(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]

    def packed(df, name):
        columns = [F.col(c) if c in df.columns else F.lit(None).cast(
            (old if c in old.columns else new).schema[c].dataType).alias(c) for c in fields]
        return df.select(key, F.struct(*columns).alias(name))

    return packed(old, "old").join(packed(new, "new"), key, "full")


def _change(absent: str, added: str, changed: str, same: str | None = None) -> Column:
    return (F.when(F.col("new").isNull(), absent).when(F.col("old").isNull(), added)
            .when(~F.col("old").eqNullSafe(F.col("new")), changed).otherwise(F.lit(same)))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys added, removed or changed between two states."""
    return _paired(old, new, key).select(key, _change("removed", "added", "changed").alias(
        "change")).filter(F.col("change").isNotNull())


def compare_counts(states: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of several states."""
    counts = [df.agg(F.count("*").alias("record_count")).select(
        F.lit(name).alias("timepoint"), "record_count") for name, df in states.items()]
    return evolve(*counts)


def rollback_preview(old: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """How many current rows a rollback would keep, remove, restore or change back."""
    action = _change("Would Restore", "Would Remove", "Would Revert", "Would Keep")
    return _paired(old, now, key).groupBy(action.alias("action")).agg(F.count("*").alias("records"))


# Change logs ---------------------------------------------------------------------------------


def puts(rows: DataFrame, version: int | Column) -> DataFrame:
    version = version if isinstance(version, Column) else F.lit(version)
    return rows.withColumn("_op", F.lit("put")).withColumn("_version", version.cast("long"))


def deletes(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumn("_op", F.lit("delete")).withColumn("_version", F.lit(version).cast("long"))


def rollback_changes(old: DataFrame, now: DataFrame, key: str, version: int) -> DataFrame:
    """Change rows of a new version whose state equals that of an old one."""
    both = _paired(old, now, key).filter(~F.col("old").eqNullSafe(F.col("new")))
    op = F.when(F.col("old").isNull(), "delete").otherwise("put")
    return both.select(key, F.coalesce("old", "new").alias("_row"), op.alias("_op")).select(
        key, "_row.*", "_op", F.lit(version).cast("long").alias("_version"))


def as_of_version(log: DataFrame, key: str, version: int | Column | None = None) -> DataFrame:
    """The table as it was at a version (the latest one by default).

    Each task keeps the newest rows of a key before the shuffle. A key that one
    version put twice keeps both rows.
    """
    if version is not None:
        log = log.filter(F.col("_version") <= version)
    newest = Window.partitionBy(key).orderBy(F.desc("_version"))
    state = log.withColumn("_rank", F.rank().over(newest)).filter("_rank = 1 AND _op = 'put'")
    return state.drop("_rank", "_op", "_version")


def version_at(commits: DataFrame, moment: Column) -> Column:
    """The last version committed at or before a moment."""
    return commits.filter(F.col("committed_at") <= moment).agg(F.max("version")).scalar()


def as_of_timestamp(log: DataFrame, commits: DataFrame, key: str, moment: Column) -> DataFrame:
    return as_of_version(log, key, version_at(commits, moment))


def expire(log: DataFrame, key: str, before: int) -> DataFrame:
    """A log without history older than a version: its state, plus all later changes."""
    base = puts(as_of_version(log, key, before), before)
    return base.unionByName(log.filter(F.col("_version") > before))


def history(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits with the number of rows each one put and deleted."""
    counts = log.groupBy(F.col("_version").alias("version")).agg(
        F.count_if(F.col("_op") == "put").alias("rows_put"),
        F.count_if(F.col("_op") == "delete").alias("rows_deleted"))
    return commits.join(counts, "version", "left").na.fill(0, ["rows_put", "rows_deleted"])


# Catalog and files ---------------------------------------------------------------------------


def file_inventory(df: DataFrame) -> DataFrame:
    """Data files behind a Parquet frame with their format and row count."""
    return (df.groupBy(F.col("_metadata.file_path").alias("file_path"))
            .agg(F.count("*").alias("record_count"))
            .withColumn("file_format", F.lit("parquet")))


def describe(spark: SparkSession, view: str) -> DataFrame:
    """Columns of a table or view with their types and nullability."""
    rows = [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(view)]
    return spark.createDataFrame(rows, "column_name STRING, data_type STRING, is_nullable BOOLEAN")


def tables(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Tables and views the session can see, with their kind."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(pattern=pattern)]
    return spark.createDataFrame(rows, "table_name STRING, table_type STRING, is_temporary BOOLEAN")
