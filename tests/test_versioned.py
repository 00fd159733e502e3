"""Versions of a table as frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import versioned as vt

COLUMNS = "id INT, name STRING, amount INT"
DAY = datetime.datetime(2024, 1, 1)
V1 = [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
V2 = [(1, "a", 10), (2, "b", 99), (3, "c", 30), (4, "d", 40)]
V3 = V2[1:]


@pytest.fixture(scope="module")
def states(spark):
    first = spark.createDataFrame(V1, COLUMNS)
    source = spark.createDataFrame([(2, "renamed", 99), (4, "d", 40)], COLUMNS)
    second = vt.upsert(first, source, "id", ["amount"])
    return first, source, second, vt.delete_where(second, F.col("amount") < 20)


@pytest.fixture(scope="module")
def log(states):
    first, source, second, _ = states
    return vt.evolve(vt.puts(first, 1), vt.puts(vt.merge_rows(first, source, "id", ["amount"]), 2),
                     vt.deletes(second.filter("amount < 20"), 3))


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "name", "amount").collect())


def test_upsert_and_delete(states):
    first, source, second, third = states
    assert rows(second) == V2 and rows(third) == V3
    assert rows(vt.merge_rows(first, source, "id", ["amount"])) == [(2, "b", 99), (4, "d", 40)]


def test_a_delete_keeps_rows_it_knows_nothing_about(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5)], COLUMNS)
    assert rows(vt.delete_where(df, F.col("amount") < 20)) == [(1, "a", None)]


def test_an_upsert_may_set_null_and_inserts_null_keys(spark):
    now = spark.createDataFrame([(1, "a", 5), (None, "n", 1)], COLUMNS)
    source = spark.createDataFrame([(1, "x", None), (None, "m", 2)], COLUMNS)
    got = {tuple(r) for r in vt.upsert(now, source, "id", ["amount"]).collect()}
    assert got == {(1, "a", None), (None, "n", 1), (None, "m", 2)}


def test_time_travel(spark, log):
    assert rows(vt.as_of_version(log, "id", 1)) == V1
    assert rows(vt.as_of_version(log, "id", 2)) == V2
    assert rows(vt.as_of_version(log, "id")) == V3
    commits = spark.createDataFrame(
        [(v, DAY + datetime.timedelta(days=v - 1), "any") for v in (1, 2, 3)],
        "version BIGINT, committed_at TIMESTAMP, operation STRING")
    moment = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert rows(vt.as_of_timestamp(log, commits, "id", moment)) == V2
    counted = {r["version"]: (r["rows_put"], r["rows_deleted"]) for r in vt.history(log, commits).collect()}
    assert counted == {1: (3, 0), 2: (2, 0), 3: (0, 1)}


def test_a_key_put_twice_in_a_version_loses_no_row(spark):
    twice = vt.puts(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], COLUMNS), 1)
    assert rows(vt.as_of_version(twice, "id")) == [(1, "a", 1), (1, "b", 2)]


def test_diff_and_counts(states):
    first, _, second, third = states
    assert {(r["id"], r["change"]) for r in vt.diff(first, third, "id").collect()} == {
        (1, "removed"), (2, "changed"), (4, "added")}
    counts = vt.compare_counts({"one": first, "two": second, "three": third}).collect()
    assert {tuple(r) for r in counts} == {("one", 3), ("two", 4), ("three", 3)}


def test_rollback_restores_the_old_state(states, log):
    first, _, _, third = states
    preview = {r["action"]: r["records"] for r in vt.rollback_preview(first, third, "id").collect()}
    assert preview == {"Would Restore": 1, "Would Revert": 1, "Would Remove": 1, "Would Keep": 1}
    rolled = log.unionByName(vt.rollback_changes(first, third, "id", 4))
    assert rows(vt.as_of_version(rolled, "id")) == V1
    assert rows(vt.as_of_version(rolled, "id", 3)) == V3


def test_expire_keeps_later_states(log):
    kept = vt.expire(log, "id", 2)
    assert rows(vt.as_of_version(kept, "id", 2)) == V2
    assert rows(vt.as_of_version(kept, "id")) == V3
    assert kept.filter("_version < 2").isEmpty()


def test_bad_merges_are_errors(spark):
    now = spark.createDataFrame([(1, 5)], "id INT, amount INT")
    twice = spark.createDataFrame([(1, 6), (1, 7)], "id INT, amount INT")
    for merge in (vt.upsert, vt.merge_rows):
        with pytest.raises(Exception, match="duplicate merge key 1"):
            merge(now, twice, "id", ["amount"]).collect()
        with pytest.raises(ValueError, match="lacks"):
            merge(now, twice, "id", ["price"])


def test_added_column_reads_null_in_old_rows(spark):
    old = spark.createDataFrame([(1, "a")], "id INT, name STRING")
    new = spark.createDataFrame([(2, "b", "+1")], "id INT, name STRING, phone STRING")
    state = vt.evolve(old, new)
    assert {r["id"]: r["phone"] for r in state.collect()} == {1: None, 2: "+1"}
    assert "mobile" in vt.renamed(state, {"phone": "mobile"}).columns
    assert {tuple(r) for r in vt.diff(old, state, "id").collect()} == {(2, "added")}


def test_tables_listing(spark):
    spark.range(1).createOrReplaceTempView("millrace_listed")
    names = {r["table_name"]: r["is_temporary"] for r in vt.tables(spark, "millrace_*").collect()}
    assert names["millrace_listed"] is True
