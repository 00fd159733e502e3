"""Row generators. Values are hashes of the row id, so every run yields the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.scalars import hash_below, hash_pick
from millrace.sources import datasets as ds

# The categories, products, places and states of the sample order file.
PRODUCTS = {
    "Electronics": ["Laptop", "Smartphone", "Tablet", "Headphones", "Camera"],
    "Clothing": ["T-Shirt", "Jeans", "Dress", "Jacket", "Shoes"],
    "Books": ["Novel", "Textbook", "Cookbook", "Biography", "Manual"],
    "Home": ["Chair", "Table", "Lamp", "Pillow", "Curtains"],
    "Sports": ["Basketball", "Soccer Ball", "Tennis Racket", "Gym Equipment", "Running Shoes"],
    "Beauty": ["Shampoo", "Lipstick", "Perfume", "Face Cream", "Nail Polish"],
    "Automotive": ["Oil Filter", "Brake Pads", "Car Charger", "Floor Mats", "Air Freshener"],
}
CITIES = {"New York": "NY", "Los Angeles": "CA", "Chicago": "IL", "Houston": "TX",
          "Phoenix": "AZ", "Philadelphia": "PA", "San Antonio": "TX"}
ORDER_STATES = ["Pending", "Shipped", "Delivered", "Cancelled"]
EVENT_TYPES = ["user_login", "page_view", "purchase", "search"]


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x])
             for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def sample_orders(ids: DataFrame, key: str = "id", first_day: str = "2023-01-01") -> DataFrame:
    """Eleven-column sample orders, one per id; the total is price times quantity."""
    k = F.col(key)
    drawn = ids.select(
        k.alias("_k"), hash_pick(list(PRODUCTS), k, F.lit("category")).alias("product_category"),
        hash_pick(list(CITIES), k, F.lit("city")).alias("ship_city"),
        (hash_below(5, k, F.lit("quantity")) + 1).alias("quantity"),
        ((hash_below(49001, k, F.lit("price")) + 1000) / 100).cast("decimal(10,2)").alias(
            "unit_price"))
    product = F.element_at(_lookup(PRODUCTS, F.col("product_category")),
                           hash_below(5, F.col("_k"), F.lit("product")) + 1)
    day = F.date_add(F.lit(first_day).cast("date"), hash_below(366, F.col("_k"), F.lit("day")))
    return drawn.select(
        F.concat(F.lit("ORD-"), (F.col("_k") + 1000).cast("string")).alias("order_id"),
        F.concat(F.lit("CUST-"), (hash_below(200, F.col("_k"), F.lit("customer")) + 1)
                 .cast("string")).alias("customer_id"),
        product.alias("product_name"), "product_category", "quantity", "unit_price",
        (F.col("unit_price") * F.col("quantity")).cast("decimal(12,2)").alias("total_amount"),
        F.date_format(day, "yyyy-MM-dd").alias("order_date"), "ship_city",
        _lookup(CITIES, F.col("ship_city")).alias("ship_state"),
        hash_pick(ORDER_STATES, F.col("_k"), F.lit("status")).alias("order_status"))


def sample_events(ids: DataFrame, key: str = "id") -> DataFrame:
    """Events of four types with a JSON payload of user, session and value."""
    k = F.col(key)
    payload = F.struct(
        (hash_below(1000, k, F.lit("user")) + 1).alias("user_id"),
        F.concat(F.lit("session_"), (hash_below(100, k, F.lit("session")) + 1)
                 .cast("string")).alias("session_id"),
        ((hash_below(9901, k, F.lit("value")) + 100) / 100).alias("value"))
    return ids.select(k.alias("id"), hash_pick(EVENT_TYPES, k, F.lit("type")).alias("event_type"),
                      F.to_json(payload).alias("event_data"))


def number_series(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Integers first..last as a table, made on the executors."""
    return spark.range(first, last + 1).withColumnRenamed("id", "i")


def day_series(first_day: Column, last_day: Column) -> Column:
    """Array of the days from first to last."""
    return F.sequence(first_day, last_day, F.expr("INTERVAL 1 DAY"))


def date_category_grid(rows: DataFrame, time: str, category: str, days: int,
                       measures: Sequence[Column]) -> DataFrame:
    """Every one of the last ``days`` days with every category, and its measures, 0 where there is no row.

    Days and categories come from one aggregate row and are exploded in place;
    only the sums per day and category are joined to them.
    """
    last = F.max(time).cast("date")
    span = rows.agg(last.alias("last"), F.collect_set(category).alias("names"))
    grid = span.select(F.explode(day_series(F.date_sub("last", days - 1), F.col("last"))).alias("date"), "names").select(
        "date", F.explode("names").alias("category"))
    recent = rows.where(F.col(time).cast("date") > F.date_sub(rows.agg(last).scalar(), days))
    sums = recent.groupBy(F.col(time).cast("date").alias("date"), F.col(category).alias("category")).agg(*measures)
    return grid.join(sums, ["date", "category"], "left").na.fill(0).select(
        "date", "category", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums.columns[2:]])


def flat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the eleven columns of a flat order file; the total is price times quantity."""
    orders, customers, nations = (ds.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    lines, parts, regions = (ds.table(spark, sf_dir, t) for t in ("lineitem", "part", "region"))
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("ship_city"), F.col("r_name").alias("ship_state"))
    quantity, price = F.col("l_quantity").cast("bigint"), F.col("p_retailprice").cast("decimal(12,2)")
    return (lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
            .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(buyers, F.col("c_custkey") == F.col("o_custkey"))
            .select(F.concat(F.lit("ORD-"), "o_orderkey").alias("order_id"),
                    F.concat(F.lit("CUST-"), "o_custkey").alias("customer_id"), F.col("p_name").alias("product_name"),
                    F.col("p_type").alias("product_category"), quantity.alias("quantity"), price.alias("unit_price"),
                    (price * quantity).alias("total_amount"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "ship_city", "ship_state",
                    F.col("o_orderstatus").alias("order_status")))


def payloads(events: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Events as type and a JSON payload of the given columns."""
    return events.select("event_type", F.to_json(F.struct(*fields)).alias("event_data"))
