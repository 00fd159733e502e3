"""The star schema behind the queries: order line sums, order facts and small views.

Each builder reads only the columns it hands on and joins only the dimensions
those columns live in. The dimensions carry no broadcast hint: Catalyst
broadcasts those whose size statistics are under its threshold, and adaptive
execution splits a hot key of the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.scalars import money, ratio

_FROM_ORDERS = {"order_date", "order_status", "customer_id"}
_FROM_PART = {"product_name", "product_category", "unit_price"}
_FROM_CUSTOMER = {"customer_name"}
_FROM_NATION = {"ship_city"}
_FROM_REGION = {"ship_state"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids and whole texts.

    Read in the splits of the files. A session whose files hold few row groups may set
    ``spark.millrace.textPartitions`` to have the rows dealt out to that many tasks.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    tasks = spark.conf.get("spark.millrace.textPartitions", None)
    return docs.repartition(int(tasks)) if tasks else docs


def last_order_day(spark: SparkSession, sf_dir: str) -> Column:
    """The newest order timestamp as a scalar subquery: the default "today" of a report."""
    return table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()


def last_event_time(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "events").agg(F.max("ts")).scalar()


def customers(spark: SparkSession, sf_dir: str, country: bool = False) -> DataFrame:
    """Every customer; an overdrawn account's e-mail lacks the @ sign.

    With ``country`` the nations are joined, and a customer without one has NULL there.
    """
    c = table(spark, sf_dir, "customer")
    address = F.concat(
        F.translate(F.lower("c_name"), "#", "_"),
        F.when(F.col("c_acctbal") < 0, "").otherwise("@"), F.lit("example.com"))
    columns = [F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
               address.alias("email"), F.col("c_mktsegment").alias("tier"),
               money("c_acctbal").alias("balance"), "c_nationkey"]
    if country:
        n = table(spark, sf_dir, "nation")
        c = c.join(n, c.c_nationkey == n.n_nationkey, "left")
        columns.insert(3, F.col("n_name").alias("country"))
    return c.select(*columns)


def orders(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """Order headers. ``since`` filters the raw column, so it reaches the scan."""
    o = table(spark, sf_dir, "orders")
    if since is not None:
        o = o.filter(F.col("o_orderdate") >= since)
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("priority"), money("o_totalprice").alias("total_amount"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order lines with the keys of their order and product."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        money("l_extendedprice").alias("total_amount"))


def line_sums(spark: SparkSession, sf_dir: str, *columns: str,
              lines: DataFrame | None = None) -> DataFrame:
    """Order lines summed per product, per order or per both, with the asked columns beside them.

    Columns: ``columns``, ``line_count``, ``quantity`` and ``total_amount``. Lines are summed on
    the keys of the joins that ``columns`` need, before those joins: a product or order that
    owns a large part of all lines leaves each map task as one row. Sums and counts of these
    rows are exactly those of the lines. ``lines`` are all order lines unless given.
    """
    wanted = set(columns)
    unknown = wanted - (_FROM_ORDERS | _FROM_PART | _FROM_CUSTOMER | _FROM_NATION | _FROM_REGION)
    if unknown:
        raise ValueError(f"unknown order line columns: {sorted(unknown)}")
    keys = (["part_id"] if wanted & _FROM_PART else []) + (["order_id"] if wanted - _FROM_PART else [])
    lines = order_lines(spark, sf_dir) if lines is None else lines
    sums = lines.groupBy(*keys).agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("quantity"),
        F.sum("total_amount").alias("total_amount"))
    return _with_dimensions(spark, sf_dir, sums, wanted).select(
        *columns, "line_count", "quantity", "total_amount")


def _with_dimensions(spark: SparkSession, sf_dir: str, line: DataFrame,
                     wanted: set[str]) -> DataFrame:
    """Joins to rows with ``part_id`` or ``order_id`` the dimensions that hold the wanted columns."""
    if wanted & _FROM_PART:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("part_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_category"), money("p_retailprice").alias("unit_price"))
        line = line.join(part, "part_id")
    needs_place = bool(wanted & (_FROM_NATION | _FROM_REGION))
    if wanted & _FROM_ORDERS or wanted & _FROM_CUSTOMER or needs_place:
        head = orders(spark, sf_dir).select(
            "order_id", "customer_id", "order_date", "order_status")
        if wanted & _FROM_CUSTOMER or needs_place:
            head = head.join(_customer_places(spark, sf_dir, wanted), "customer_id")
        line = line.join(head, "order_id")
    return line


def _customer_places(spark: SparkSession, sf_dir: str, wanted: set[str]) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        "c_nationkey")
    if not wanted & (_FROM_NATION | _FROM_REGION):
        return c
    n = table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_regionkey", F.col("n_name").alias("ship_city"))
    if wanted & _FROM_REGION:
        r = table(spark, sf_dir, "region").select(
            "r_regionkey", F.col("r_name").alias("ship_state"))
        n = n.join(r, n.n_regionkey == r.r_regionkey)
    return c.join(n, c.c_nationkey == n.n_nationkey)


def _order_amounts(spark: SparkSession, sf_dir: str, since: Column | None) -> DataFrame:
    """Amount per order and category.

    Lines are summed on the map side already, so a hot product or order shrinks
    before the shuffle, the orders join meets one row per pair, and a distinct
    order count turns into a row count. With ``since`` the lines of older
    orders are dropped before any of that. A task hashes the recent order ids of
    its partition for it and lets the lines stream past, as a sort-merge join
    would sort the lines of all orders.
    """
    lines = order_lines(spark, sf_dir)
    if since is not None:
        recent = orders(spark, sf_dir, since).select("order_id").hint("shuffle_hash")
        lines = lines.join(recent, "order_id", "left_semi")
    lines = _with_dimensions(spark, sf_dir, lines, {"product_category"})
    return lines.groupBy("order_id", "product_category").agg(
        F.sum("total_amount").alias("amount"))


def order_facts(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """Orders, revenue and mean order value per day, category and region."""
    head = (orders(spark, sf_dir, since).select("order_id", "customer_id", "order_date")
            .join(_customer_places(spark, sf_dir, {"ship_state"})
                  .select("customer_id", F.col("ship_state").alias("customer_region")),
                  "customer_id"))
    facts = (_order_amounts(spark, sf_dir, since).join(head, "order_id")
             .groupBy("order_date", "product_category", "customer_region")
             .agg(F.count("*").alias("order_count"), F.sum("amount").alias("total_revenue")))
    return facts.withColumn("avg_order_value",
                            ratio(F.col("total_revenue"), F.col("order_count")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.col("props").alias("event_data"),
                    F.col("ts").alias("event_time"), "user_id", money("value").alias("value"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_items(table(spark, sf_dir, "part"))


def as_items(part: DataFrame) -> DataFrame:
    """Catalogue items with the attributes the profiles and the recommender use."""
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"),
                    F.col("p_brand").alias("category"), F.col("p_type").alias("domain"),
                    F.col("p_size").cast("long").alias("complexity"),
                    money("p_retailprice").alias("cost"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").alias("vector"),
                    F.col("label").alias("category"))


def day_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard grid: value, users and sessions per day and event type."""
    return (events(spark, sf_dir)
            .groupBy(F.col("event_time").cast("date").alias("date"),
                     F.col("event_type").alias("category"))
            .agg(F.sum("value").alias("value"), F.countDistinct("user_id").alias("users"),
                 F.count("*").alias("sessions")))


def category_sales(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """New orders and revenue per batch day and category, as a sales stream would append them."""
    head = orders(spark, sf_dir, since).select("order_id", F.col("order_date").alias("batch_date"))
    sales = (_order_amounts(spark, sf_dir, since).join(head, "order_id")
             .groupBy("batch_date", "product_category")
             .agg(F.count("*").alias("new_orders"), F.sum("amount").alias("new_revenue")))
    return sales.withColumn("avg_new_order_value",
                            ratio(F.col("new_revenue"), F.col("new_orders")))
