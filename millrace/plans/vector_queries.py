"""Vector search, similarity and clustering (ids V1-V7, V13-V21, V25, J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.scalars import md5_vector
from millrace.operators import vectors as vx
from millrace.operators.aggregates import histogram
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import CUSTOMERS, VECTORS
from millrace.sources import datasets as ds, sinks
from millrace.sources.shared import shared_folder

Q = QuerySet()

_DIMS = 64
# Query vectors along five axes and along the diagonal.
_QUERIES = {f"axis_{j}": [1.0 if i == j else 0.0 for i in range(_DIMS)] for j in range(5)}
_QUERIES["diagonal"] = [0.125] * _DIMS

_QUERY_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{name}' AS query_id, CAST({values} AS DOUBLE[]) AS qv"
    for name, values in _QUERIES.items()) + ")"

_SCORED_SQL = f"""(SELECT query_id, id, category,
    round(list_sum(list_transform(range(1, 65), lambda i: (vector[i] - qv[i]) ** 2)), 9)
      AS distance,
    round(list_dot_product(vector, qv) / (sqrt(list_dot_product(vector, vector))
      * sqrt(list_dot_product(qv, qv))), 9) AS similarity
    FROM {VECTORS} AS v CROSS JOIN {_QUERY_SQL} AS q)"""


def _ranked_sql(order: str, k: int, where: str = "") -> str:
    return f"""SELECT * FROM (SELECT query_id, ROW_NUMBER() OVER (PARTITION BY query_id
        ORDER BY {order}, id) AS rank, id, distance, similarity
        FROM {_SCORED_SQL} AS s {where}) AS r WHERE rank <= {k}"""


_HEX = "(instr('0123456789abcdef', substr(h, {p}, 1)) - 1)"
_BYTE = f"{_HEX.format(p='2 * b + 1')} * 16 + {_HEX.format(p='2 * b + 2')}"


@Q.add("V1_text_embedding", "doc_id long, dims long, cells str",
       f"""SELECT doc_id, 128 AS dims, array_to_string(list_transform(range(0, 128),
             lambda j: CAST(list_extract(bytes, CAST(j % 16 AS INTEGER) + 1) AS VARCHAR)), ',')
             AS cells
           FROM (SELECT doc_id, list_transform(range(0, 16), lambda b: {_BYTE}) AS bytes
             FROM (SELECT doc_id, md5(text) AS h FROM documents) AS x) AS y""")
def v1(spark, sf):
    v = md5_vector(F.col("text"))
    whole = F.transform("v", lambda x: F.round(x * 255).cast("int").cast("string"))
    return ds.table(spark, sf, "documents").select("doc_id", v.alias("v")).select(
        "doc_id", F.size("v").alias("dims"), F.array_join(whole, ",").alias("cells"))


_HIT_COLUMNS = "query_id str, rank long, id long, distance dbl6, similarity dbl6"


@Q.add("V2_nearest", _HIT_COLUMNS, _ranked_sql("distance", 10))
def v2(spark, sf):
    return vx.nearest(ds.vectors(spark, sf), _QUERIES, 10)


@Q.add("V2_nearest_cosine", _HIT_COLUMNS, _ranked_sql("similarity DESC", 10))
def v2_cosine(spark, sf):
    return vx.nearest(ds.vectors(spark, sf), _QUERIES, 10, metric="similarity")


_NAMES = {"first": "Customer#000000001", "other": "red ring"}
_NAME_VECTORS = f"""b AS (SELECT customer_id AS id, list_transform(range(0, 16), lambda b: {_BYTE}) AS v
      FROM (SELECT customer_id, md5(customer_name) AS h FROM {CUSTOMERS} AS c) AS x),
    q AS (SELECT query_id, list_transform(range(0, 16), lambda b: {_BYTE}) AS qv FROM (""" + " UNION ALL ".join(
    f"SELECT '{k}' AS query_id, md5('{t}') AS h" for k, t in _NAMES.items()) + ") AS y)"


@Q.add("V2_nearest_to_text", "query_id str, rank long, id long, distance dbl6",
       f"""WITH {_NAME_VECTORS} SELECT * FROM (SELECT query_id, id, d AS distance,
             ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (
               SELECT query_id, id, round(list_sum(list_transform(range(1, 17), lambda i:
                 (v[i] / 255.0::DOUBLE - qv[i] / 255.0::DOUBLE) ** 2)) * 8, 9) AS d
               FROM b CROSS JOIN q) AS s) AS r WHERE rank <= 10""")
def v2_text(spark, sf):
    c = ds.customers(spark, sf).select(
        F.col("customer_id").alias("id"), md5_vector(F.col("customer_name")).alias("vector"))
    return vx.nearest_to_text(c, _NAMES, 10)


@Q.add("V3_nearest_in_category", _HIT_COLUMNS, _ranked_sql("distance", 3, "WHERE category = 3"))
def v3(spark, sf):
    return vx.nearest(ds.vectors(spark, sf), _QUERIES, 3, category=3)


@Q.add("V4_first_rows", "id long, category long",
       f"SELECT id, category FROM {VECTORS} AS v ORDER BY id LIMIT 10")
def v4(spark, sf):
    return vx.nearest_or_first(ds.vectors(spark, sf), None, 10)


@Q.add("V5_more_like_this", "id long, distance dbl6, similarity dbl6",
       f"""SELECT v.id, list_sum(list_transform(range(1, 65), lambda i: (v.vector[i] - q.vector[i])
             ** 2)) AS distance, list_dot_product(v.vector, q.vector)
             / (sqrt(list_dot_product(v.vector, v.vector))
             * sqrt(list_dot_product(q.vector, q.vector))) AS similarity
           FROM {VECTORS} AS v CROSS JOIN (SELECT * FROM {VECTORS} AS w ORDER BY id LIMIT 1) AS q
           ORDER BY 2, 1 LIMIT 5""")
def v5(spark, sf):
    return vx.more_like_first(ds.vectors(spark, sf), 5)


@Q.add("V6_append_records", "id long, text str, category str, dims long",
       """SELECT c_custkey AS id, c_name AS text, 'customer' AS category, 128 AS dims FROM customer
          UNION ALL SELECT (SELECT MAX(c_custkey) FROM customer)
            + ROW_NUMBER() OVER (ORDER BY s_suppkey), s_name, 'supplier', 128 FROM supplier""")
def v6(spark, sf):
    path = shared_folder(spark, "vector-table")
    none = F.lit(None).cast("array<double>").alias("vector")

    def records(table, key, name, given):
        return ds.table(spark, sf, table).select(
            (F.col(key) if given else F.lit(None).cast("long")).alias("id"),
            F.col(name).alias("text"), F.lit(table).alias("category"), none,
            F.col(key).alias("arrival"))

    sinks.append_parquet(vx.append_records(
        None, records("customer", "c_custkey", "c_name", True), "arrival"), path)
    sinks.append_parquet(vx.append_records(
        spark.read.parquet(path), records("supplier", "s_suppkey", "s_name", False), "arrival"),
        path)
    return spark.read.parquet(path).withColumn("dims", F.size("vector"))


@Q.add("V7_table_info", "row_count long, min_dims long, max_dims long, categories long",
       f"""SELECT COUNT(*) AS row_count, MIN(len(vector)) AS min_dims, MAX(len(vector)) AS max_dims,
           COUNT(DISTINCT category) AS categories FROM {VECTORS} AS v""")
def v7(spark, sf):
    return vx.table_info(ds.vectors(spark, sf))


@Q.add("V7_table_samples", "id long, category long, dims long",
       f"SELECT id, category, len(vector) AS dims FROM {VECTORS} AS v ORDER BY id LIMIT 3")
def v7_samples(spark, sf):
    return vx.table_samples(ds.vectors(spark, sf), 3).withColumn("dims", F.size("vector"))


@Q.add("V7_table_columns", "place long, column_name str, known long",
       f"""SELECT 0 AS place, 'id' AS column_name, COUNT(id) AS known FROM {VECTORS} AS v
           UNION ALL SELECT 1, 'vector', COUNT(vector) FROM {VECTORS} AS v
           UNION ALL SELECT 2, 'category', COUNT(category) FROM {VECTORS} AS v""")
def v7_columns(spark, sf):
    return vx.table_columns(ds.vectors(spark, sf).select("id", "vector", "category"))


@Q.add("V7_table_list", "table_name str, row_count long, min_dims long, max_dims long, fields long",
       f"""SELECT 'customer_names' AS table_name, COUNT(*) AS row_count, 128 AS min_dims, 128 AS max_dims, 2 AS fields
           FROM {CUSTOMERS} AS c UNION ALL
           SELECT 'items', COUNT(*), MIN(len(vector)), MAX(len(vector)), 3 FROM {VECTORS} AS v""")
def v7_list(spark, sf):
    """Two vector tables and a plain one in a database of the catalog; the vector tables are listed."""
    path = shared_folder(spark, "vector-db")
    database = f"millrace_{path.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    names = ds.customers(spark, sf).select(F.col("customer_id").alias("id"), "customer_name")
    for name, df in (("items", ds.vectors(spark, sf).select("id", "vector", "category")),
                     ("customer_names", names.select("id", md5_vector(F.col("customer_name")).alias("vector"))),
                     ("plain", names)):
        sinks.replace_table(df, f"{database}.{name}", f"{path}/{name}")
    listed = vx.table_list(spark, database)
    return listed.withColumn("fields", F.regexp_count("schema", F.lit(r"(?:^struct<|,)\w+:")))


@Q.add("J5_query_corpus_product", "query_id str, id long, distance dbl6, similarity dbl6",
       f"SELECT query_id, id, distance, similarity FROM {_SCORED_SQL} AS s")
def j5(spark, sf):
    return vx.query_product(ds.vectors(spark, sf), _QUERIES)


_UNITS = f"""u AS (SELECT id, category, UNNEST(range(1, len(vector) + 1)) AS d,
    UNNEST(vector) / sqrt(list_dot_product(vector, vector)) AS x FROM {VECTORS} AS v)"""


@Q.add("V13_similarity_blocks", "category_a long, category_b long, pairs long, "
       "mean_similarity dbl6",
       f"""WITH {_UNITS}, m AS (SELECT category, d, AVG(x) AS x FROM u GROUP BY 1, 2),
           n AS (SELECT category, COUNT(*) AS n FROM {VECTORS} AS v GROUP BY 1)
           SELECT a.category AS category_a, b.category AS category_b,
           MAX(na.n) * MAX(nb.n) AS pairs, SUM(a.x * b.x) AS mean_similarity
           FROM m a JOIN m b ON a.d = b.d JOIN n na ON na.category = a.category
           JOIN n nb ON nb.category = b.category GROUP BY 1, 2""")
def v13(spark, sf):
    return vx.similarity_blocks(ds.vectors(spark, sf))


@Q.add("V14_matrix_mean", "row_count long, mean_similarity dbl6, mean_between_distinct dbl6",
       f"""WITH {_UNITS}, m AS (SELECT d, AVG(x) AS x FROM u GROUP BY 1),
           s AS (SELECT SUM(x * x) AS s FROM m), n AS (SELECT COUNT(*)::DOUBLE AS n FROM embeddings)
           SELECT n AS row_count, s AS mean_similarity,
           (s * n * n - n) / (n * (n - 1)) AS mean_between_distinct FROM s CROSS JOIN n""")
def v14(spark, sf):
    return vx.mean_similarity(ds.vectors(spark, sf))


@Q.add("V14_query_line_stats", "query_id str, mean_similarity dbl6, max_below_one dbl6, "
       "min_similarity dbl6",
       f"""SELECT query_id, AVG(similarity) AS mean_similarity,
           MAX(CASE WHEN similarity < 1 THEN similarity END) AS max_below_one,
           MIN(similarity) AS min_similarity FROM {_SCORED_SQL} AS s GROUP BY 1""")
def v14_lines(spark, sf):
    return vx.similarity_stats(ds.vectors(spark, sf), _QUERIES)


@Q.add("V15_mean_similarity_per_row", "id long, mean_similarity dbl6",
       f"""WITH {_UNITS}, m AS (SELECT d, AVG(x) AS m FROM u GROUP BY 1)
           SELECT id, SUM(x * m) AS mean_similarity FROM u JOIN m USING (d) GROUP BY 1""")
def v15(spark, sf):
    return vx.mean_similarity_per_row(ds.vectors(spark, sf))


@Q.add("V16_vector_norms", "id long, norm dbl6",
       f"SELECT id, sqrt(list_dot_product(vector, vector)) AS norm FROM {VECTORS} AS v")
def v16(spark, sf):
    return vx.norms(ds.vectors(spark, sf))


_TEXT_NORM = f"""(SELECT sqrt(list_sum(list_transform(range(0, 16),
    lambda b: (({_BYTE}) / 255.0::DOUBLE) ** 2)) * 8) AS norm
    FROM (SELECT md5(customer_name) AS h FROM {CUSTOMERS} AS c) AS x)"""


@Q.add("V16_norm_histogram", "bin long, row_count long",
       f"""WITH v AS (SELECT norm FROM {_TEXT_NORM} AS n),
           s AS (SELECT MIN(norm) AS lo, MAX(norm) AS hi FROM v)
           SELECT LEAST(FLOOR((norm - lo) / ((hi - lo) / 15)), 14) AS bin, COUNT(*) AS row_count
           FROM v CROSS JOIN s GROUP BY 1""")
def v16_histogram(spark, sf):
    c = ds.customers(spark, sf).select(
        F.col("customer_id").alias("id"), md5_vector(F.col("customer_name")).alias("vector"))
    return histogram(vx.norms(c), "norm", 15)


_CENTROIDS = f"""c AS (SELECT category, list(x ORDER BY d) AS center FROM (
      SELECT category, d, AVG(x) AS x FROM (SELECT category,
        UNNEST(range(1, len(vector) + 1)) AS d, UNNEST(vector) AS x FROM {VECTORS} AS v) AS e
      GROUP BY 1, 2) AS m GROUP BY 1),
    a AS (SELECT id, category, cluster, distance FROM (SELECT v.id, v.category,
        c.category AS cluster, g AS distance,
        ROW_NUMBER() OVER (PARTITION BY v.id ORDER BY g, c.category) AS rn
      FROM (SELECT * FROM {VECTORS} AS w) AS v CROSS JOIN c CROSS JOIN LATERAL (SELECT
        round(list_sum(list_transform(range(1, 65), lambda i:
          (v.vector[i] - c.center[i]) ** 2)), 9) AS g) AS l) AS r WHERE rn = 1)"""


def _clustered(spark, sf):
    v = ds.vectors(spark, sf)
    return vx.assign_nearest(v, vx.category_centroids(v))


@Q.add("V18_kmeans_clusters", "id long, at_nearest bool",
       f"SELECT id, TRUE AS at_nearest FROM {VECTORS} AS v")
def v18(spark, sf):
    # Cluster numbers depend on the solver; that each row is at its nearest centre does not.
    rows, centers = vx.kmeans_clusters(ds.vectors(spark, sf), 4, 42)
    return vx.assign_nearest(rows.withColumnRenamed("cluster", "own"), centers).withColumn(
        "at_nearest", F.col("own") == F.col("cluster"))


@Q.add("V18_kmeans_ten_starts", "id long, clustered bool, best_start bool",
       f"SELECT id, TRUE AS clustered, TRUE AS best_start FROM {VECTORS} AS v")
def v18_starts(spark, sf):
    # Which start wins depends on the data; that none of the ten is cheaper than the one used does not.
    rows, centers, costs = vx.kmeans_starts(ds.vectors(spark, sf), 4)
    total = rows.agg(F.sum("distance")).scalar()
    return rows.withColumns({"clustered": F.col("cluster").isNotNull(),
                             "best_start": total <= F.lit(min(costs) * (1 + 1e-6))})


@Q.add("V18_nearest_centroid", "id long, cluster long, distance dbl6",
       f"WITH {_CENTROIDS} SELECT id, cluster, distance FROM a")
def v18_assign(spark, sf):
    return _clustered(spark, sf)


@Q.add("V19_cluster_profile", "cluster long, size long, avg_distance dbl6, "
       "dominant_category long, samples str",
       f"""WITH {_CENTROIDS},
           m AS (SELECT cluster, category, ROW_NUMBER() OVER (PARTITION BY cluster
             ORDER BY COUNT(*) DESC, category) AS rn FROM a GROUP BY 1, 2),
           s AS (SELECT cluster, STRING_AGG(CAST(id AS VARCHAR), ', ' ORDER BY id) AS samples
             FROM (SELECT cluster, id, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY id) AS rn
               FROM a) AS r WHERE rn <= 3 GROUP BY 1)
           SELECT a.cluster, COUNT(*) AS size, AVG(a.distance) AS avg_distance,
           MAX(m.category) AS dominant_category, MAX(s.samples) AS samples
           FROM a JOIN m ON a.cluster = m.cluster AND m.rn = 1 JOIN s ON s.cluster = a.cluster
           GROUP BY 1""")
def v19(spark, sf):
    return vx.cluster_profile(_clustered(spark, sf).withColumn("label", F.col("id")),
                              ["distance"], ["category"], "label", 3)


@Q.add("V20_cluster_composition", "cluster long, category long, row_count long",
       f"""WITH {_CENTROIDS} SELECT cluster, category, COUNT(*) AS row_count FROM a GROUP BY 1, 2""")
def v20(spark, sf):
    return _clustered(spark, sf).groupBy("cluster", "category").agg(
        F.count("*").alias("row_count"))


@Q.add("V21_principal_plane", "row_count long, mean_x dbl6, mean_y dbl6, correlation dbl6, "
       "ordered bool, share_kept bool",
       f"""SELECT COUNT(*) AS row_count, 0.0 AS mean_x, 0.0 AS mean_y, 0.0 AS correlation,
           TRUE AS ordered, TRUE AS share_kept FROM {VECTORS} AS v""")
def v21(spark, sf):
    # Axis signs are the solver's choice; these properties of the plane are not.
    v = ds.vectors(spark, sf)
    rows, variance = vx.principal_plane(v, 2)
    x, y = F.col("point")[0], F.col("point")[1]
    total = v.select(F.posexplode("vector").alias("at", "cell")).groupBy("at").agg(
        F.var_pop(F.col("cell").cast("double")).alias("spread")).agg(F.sum("spread")).scalar()
    return rows.agg(
        F.count("*").alias("row_count"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.corr(x, y).alias("correlation"), (F.var_pop(x) >= F.var_pop(y)).alias("ordered"),
        (F.abs(F.var_pop(x) + F.var_pop(y) - sum(variance) * total) < 1e-6 * total).alias("share_kept"))


@Q.add("V25_image_metadata", "id long, filename str, tags str, vector_dim long, width long, "
       "height long",
       """SELECT doc_id AS id, 'page_' || doc_id || '.png' AS filename, lang || ', ' || source
            AS tags, 128 AS vector_dim, n_chars AS width, 0 AS height FROM documents""")
def v25(spark, sf):
    images = ds.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("page_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"),
        F.array("lang", "source").alias("tags"), md5_vector(F.col("text")).alias("vector"),
        F.to_json(F.struct(F.col("n_chars").alias("width"))).alias("metadata"))
    return vx.flatten_image_metadata(images)
