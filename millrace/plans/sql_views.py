"""Derived tables used by the checking SQL."""

LINES = """(SELECT l.l_orderkey AS order_id, l.l_quantity AS quantity,
  CAST(l.l_extendedprice AS DECIMAL(12,2)) AS total_amount,
  CAST(o.o_orderdate AS DATE) AS order_date, o.o_orderstatus AS order_status,
  p.p_name AS product_name, p.p_type AS product_category,
  CAST(p.p_retailprice AS DECIMAL(12,2)) AS unit_price, c.c_custkey AS customer_id,
  c.c_name AS customer_name, n.n_name AS ship_city, r.r_name AS ship_state
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

FACTS = f"""(SELECT order_date, product_category, ship_state AS customer_region,
  COUNT(DISTINCT order_id) AS order_count, SUM(total_amount) AS total_revenue,
  CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT order_id) AS avg_order_value
  FROM {LINES} AS x GROUP BY 1, 2, 3)"""

SALES = f"""(SELECT order_date AS batch_date, product_category,
  COUNT(DISTINCT order_id) AS new_orders, SUM(total_amount) AS new_revenue,
  CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT order_id) AS avg_new_order_value
  FROM {LINES} AS x GROUP BY 1, 2)"""

CUSTOMERS = """(SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
  replace(lower(c.c_name), '#', '_') || CASE WHEN c.c_acctbal < 0 THEN '' ELSE '@' END
    || 'example.com' AS email,
  n.n_name AS country, c.c_mktsegment AS tier, c.c_nationkey,
  CAST(c.c_acctbal AS DECIMAL(12,2)) AS balance
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

ORDERS = """(SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS order_status,
  o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount FROM orders)"""

EVENTS = """(SELECT event_id, event_type, props AS event_data, ts AS event_time, user_id,
  CAST(value AS DECIMAL(12,2)) AS value FROM events)"""

ITEMS = """(SELECT p_partkey AS id, p_name AS text, p_brand AS category, p_type AS domain,
  CAST(p_size AS BIGINT) AS complexity, CAST(p_retailprice AS DECIMAL(12,2)) AS cost FROM part)"""

VECTORS = """(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS category
  FROM embeddings)"""

GRID = f"""(SELECT CAST(event_time AS DATE) AS date, event_type AS category,
  SUM(value) AS value, COUNT(DISTINCT user_id) AS users, COUNT(*) AS sessions
  FROM {EVENTS} AS x GROUP BY 1, 2)"""

LAST_DAY = "(SELECT CAST(MAX(o_orderdate) AS DATE) FROM orders)"
LAST_EVENT = "(SELECT MAX(ts) FROM events)"


def mean(amount: str, count: str = "COUNT(*)") -> str:
    return f"CAST(SUM({amount}) AS DOUBLE) / NULLIF({count}, 0)"
