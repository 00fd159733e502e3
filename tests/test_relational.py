"""Joins, aggregates, rankings and windows on small literal inputs."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates as agg, joins, quality, ranking, windows


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [(1, "John Doe", "john@example.com", "New York"),
         (2, "Jane Smith", "jane@example.com", "Los Angeles"),
         (3, "Bob Johnson", "bob@example.com", "Chicago")],
        "id INT, name STRING, email STRING, city STRING")


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [(101, 1, 150.0, "2024-01-15"), (102, 2, 200.0, "2024-01-16"), (103, 1, 75.0, "2024-01-17")],
        "order_id INT, customer_id INT, amount DOUBLE, date STRING").withColumn(
        "amount", F.col("amount").cast("decimal(12,2)"))


def test_customer_totals(customers, orders):
    rows = joins.parent_totals(customers, orders, "id", "customer_id", ["name", "city"],
                               "amount").collect()
    by_name = {r["name"]: r for r in rows}
    assert by_name["John Doe"]["child_count"] == 2 and by_name["John Doe"]["total"] == 225
    assert by_name["Jane Smith"]["mean"] == 200.0
    assert by_name["Bob Johnson"]["child_count"] == 0 and by_name["Bob Johnson"]["total"] is None
    assert by_name["John Doe"]["joined_rows"] == 2 and by_name["Bob Johnson"]["joined_rows"] == 1


def test_sales_totals(spark):
    sales = spark.createDataFrame(
        [("Laptop", 1200, "North"), ("Phone", 800, "South"), ("Laptop", 1500, "South"),
         ("Tablet", 400, "North"), ("Phone", 900, "North")],
        "product STRING, sales INT, region STRING")
    rows = agg.revenue_by(sales, ["region"], "sales", "n", "total", None).collect()
    assert {r["region"]: (r["n"], r["total"]) for r in rows} == {
        "North": (3, 2500), "South": (2, 2300)}


def test_quality_suite_on_clean_rows(customers, orders):
    results = quality.suite(
        quality.run_checks(customers, {
            "unique": quality.duplicates("id"),
            "email": quality.violations(~F.col("email").like("%@%"))}),
        quality.run_checks(orders, {"amount": quality.violations(F.col("amount") <= 0)}),
        quality.referential_check("reference", orders, customers, "customer_id", "id"))
    assert [r["observed"] for r in results.collect()] == [0, 0, 0, 0]
    assert quality.score(results).first()["score"] == 100
    assert quality.existence(orders.filter("amount > 9999")).first()["status"] == "no_data"


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(40)}", rng.randrange(50))
            for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id INT, grp STRING, v INT").repartition(16)


def test_top_n_with_a_hot_group(skewed):
    rows, df = skewed
    got = ranking.top_n_per_group(df, ["grp"], [F.desc("v"), F.asc("id")], 5, F.col("id"))
    groups = defaultdict(list)
    for i, g, v in rows:
        groups[g].append((-v, i))
    want = {(g, n, i) for g, members in groups.items()
            for n, (_, i) in enumerate(sorted(members)[:5], 1)}
    assert {(r["grp"], r["rank"], r["id"]) for r in got.collect()} == want


def test_best_per_id(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (1, 0.9, "b"), (2, 0.7, "a"), (3, 0.1, "c")],
                               "id INT, s DOUBLE, src STRING")
    rows = ranking.best_per_id(df, "id", [F.desc("s"), F.asc("id"), F.asc("src")], 2,
                               F.col("src")).collect()
    assert [(r["id"], r["src"]) for r in rows] == [(1, "b"), (2, "a")]


def test_dense_row_number_is_gapless_over_blocks(spark):
    keys = random.Random(3).sample(range(-500, 5000), 400) + [10 ** 12, -10 ** 12, 2 ** 63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k LONG").repartition(7)
    rows = ranking.dense_row_number(df, "k", "n", block=10).collect()
    assert {r["k"]: r["n"] for r in rows} == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_most_frequent_prefers_the_lowest_on_ties(skewed):
    rows, df = skewed
    got = {r["grp"]: r["m"] for r in ranking.most_frequent(df, ["grp"], "v", "m").collect()}
    counts = defaultdict(Counter)
    for _, g, v in rows:
        counts[g][v] += 1
    assert got == {g: min(c, key=lambda v: (-c[v], v)) for g, c in counts.items()}


def test_shares_sum_to_a_hundred(skewed):
    counts = skewed[1].groupBy("grp").agg(F.count("*").alias("n"))
    total = ranking.share_of_total(counts, "n", places=6).agg(F.sum("percentage")).first()[0]
    assert abs(float(total) - 100) < 1e-3


def test_id_pages_are_bounded_and_whole(spark):
    df = spark.range(0, 2500).withColumn("g", F.when(F.col("id") < 2400, "a").otherwise("b"))
    rows = agg.id_pages(df, "g", "id", page=100).collect()
    assert max(r["records"] for r in rows) <= 100
    listed = [int(x) for r in sorted(rows, key=lambda r: (r["g"], r["page"]))
              for x in r["ids"].split(", ")]
    assert listed == list(range(2500))


def test_trailing_mean_and_lag_equal_brute_force(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=2 * i) for i in range(40)]
    values = [random.Random(1).randrange(100) + i for i in range(40)]
    df = spark.createDataFrame(list(zip(days, values)), "d DATE, v INT")
    rows = windows.week_over_week(windows.trailing_mean(df, "d", "v", 7, "m"), "d", "v").orderBy(
        "d").collect()
    for i, row in enumerate(rows):
        part = values[max(0, i - 6):i + 1]
        assert row["m"] == sum(part) / len(part)
        assert row["revenue_week_ago"] == (values[i - 7] if i >= 7 else None)


def test_growth_over_zero_is_null(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, i), 0 if i == 1 else i) for i in range(1, 9)],
                               "d DATE, v INT")
    last = windows.week_over_week(df, "d", "v").orderBy(F.desc("d")).first()
    assert last["revenue_week_ago"] == 0 and last["week_over_week_pct"] is None


def test_anomaly_labels(spark):
    df = spark.createDataFrame([(i, 100 + (i % 3)) for i in range(60)] + [(60, 1000)],
                               "d INT, daily_revenue INT")
    rows = windows.anomalies(df).collect()
    assert [(r["d"], r["status"]) for r in rows] == [(60, "ANOMALY")]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 9.99, 10, 10]], "v DOUBLE")
    assert {r["bin"]: r["row_count"] for r in agg.histogram(df, "v", 5).collect()} == {
        0: 2, 1: 1, 4: 3}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v DOUBLE")
    assert [tuple(r) for r in agg.histogram(flat, "v", 5).collect()] == [(0, 2)]


def test_permuted_input_gives_equal_output(skewed):
    _, df = skewed
    one = agg.revenue_by(df, ["grp"], "v").orderBy("grp").collect()
    two = agg.revenue_by(df.orderBy(F.rand(5)), ["grp"], "v").orderBy("grp").collect()
    assert one == two


def test_composed_query(orders):
    rows = agg.composed(orders, ["amount > 100", "customer_id = 1"], ["customer_id"],
                        [F.sum("amount").alias("t")]).collect()
    assert [(r["customer_id"], float(r["t"])) for r in rows] == [(1, 150.0)]
    assert agg.composed(orders, ["amount > 100"]).count() == 2


def test_hash_values_repeat_and_stay_in_range(spark):
    from millrace.functions.scalars import hash_below, hash_pick
    df = spark.range(1000).select(
        "id", hash_below(7, F.col("id")).alias("n"), hash_pick(["x", "y"], F.col("id")).alias("c"))
    one, two = sorted(df.collect()), sorted(df.repartition(9).collect())
    assert one == two
    assert {r["n"] for r in one} == set(range(7)) and {r["c"] for r in one} == {"x", "y"}


def test_hot_parent_is_joined_as_one_row(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id INT, g STRING")
    kids = spark.range(900).select(F.when(F.col("id") < 600, 1).otherwise(2).alias("pid"),
                                   F.lit(1).cast("decimal(12,2)").alias("amount"))
    got = {r["g"]: r for r in joins.parent_totals(parents, kids, "id", "pid", ["g"],
                                                  "amount").collect()}
    assert (got["a"]["child_count"], got["a"]["parent_count"], got["a"]["total"]) == (900, 2, 900)
    assert (got["b"]["child_count"], got["b"]["joined_rows"], got["b"]["mean"]) == (0, 1, None)
