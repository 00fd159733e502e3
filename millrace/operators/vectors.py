"""Vector search, similarity statistics, clustering and projection.

A vector table has the columns ``id`` (integer) and ``vector`` (array of float
or double, one size), and optionally ``category``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from millrace.functions import vector_kernels as kernels, vectors as vec
from millrace.functions.scalars import md5_vector, ratio
from millrace.operators.ranking import dense_row_number, most_frequent, top_n_per_group
from millrace.operators.small_sets import in_blocks

#: Centroids sent along with a task at a time; more of them take further passes.
BLOCK = 10_000
_SCORES = "query_id string, id long, distance double, similarity double"


def _scorable(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("id").cast("long").alias("id"), "vector")


def query_product(corpus: DataFrame, queries: Mapping[str, Sequence[float]]) -> DataFrame:
    """Squared L2 distance and cosine of every corpus row to every query vector.

    The queries travel with the task; the corpus is neither joined nor shuffled.
    A row without a vector comes with NULL scores.
    """
    matrix = np.array(list(queries.values()), dtype=float)
    return _scorable(corpus).mapInArrow(kernels.all_of_batch(list(queries), matrix), _SCORES)


def nearest(corpus: DataFrame, queries: Mapping[str, Sequence[float]], k: int = 10,
            metric: str = "distance", category: object | None = None) -> DataFrame:
    """The ``k`` nearest rows per query under squared L2 ``distance`` or ``similarity`` (cosine).

    With ``category`` only rows of that category are ranked; rows without a
    vector are not. Each batch keeps its
    own ``k`` best per query, so what is shuffled does not grow with the rows of a batch.
    """
    if category is not None:
        corpus = corpus.filter(F.col("category") == F.lit(category))
    matrix = np.array(list(queries.values()), dtype=float)
    by_distance = metric == "distance"
    kept = _scorable(corpus).mapInArrow(
        kernels.best_of_batch(list(queries), matrix, k, by_distance), _SCORES)
    best = F.asc("distance") if by_distance else F.desc("similarity")
    return top_n_per_group(kept, ["query_id"], [best, F.asc("id")], k, F.col("id"))


def nearest_to_text(corpus: DataFrame, texts: Mapping[str, str], k: int = 10, dims: int = 128,
                    metric: str = "distance") -> DataFrame:
    """Search with texts: each is embedded as the stored rows were, then its nearest rows are found."""
    return nearest(corpus, {name: text_vector(text, dims) for name, text in texts.items()}, k, metric)


def text_vector(text: str, dims: int = 128) -> list[float]:
    """The embedding ``md5_vector`` gives a text, for a query held by the driver."""
    cells = [b / 255.0 for b in hashlib.md5(text.encode()).digest()]
    return [cells[i % len(cells)] for i in range(dims)]


def nearest_or_first(corpus: DataFrame, vector: Sequence[float] | None, k: int) -> DataFrame:
    """Search with a vector; without one, the first ``k`` rows by id."""
    if vector is None:
        return corpus.orderBy("id").limit(k)
    hits = nearest(corpus, {"query": vector}, k)
    return corpus.join(F.broadcast(hits.select("id", "rank")), "id")  # k rows


def more_like_first(corpus: DataFrame, k: int = 5) -> DataFrame:
    """Rows most like the one with the lowest id, by distance, with cosine beside it."""
    first = corpus.select("id", "vector").orderBy("id").limit(1).collect()
    if not first:
        return query_product(corpus, {"first": [0.0]}).drop("query_id")
    hits = nearest(corpus, {"first": first[0]["vector"]}, k)
    return hits.select("id", "distance", "similarity").orderBy("distance", "id")


def append_records(existing: DataFrame | None, records: DataFrame, key: str,
                   dims: int = 128) -> DataFrame:
    """The rows to add to a vector table: missing vectors embedded, missing ids numbered.

    New ids follow the highest id in use, in the order of the unique integer ``key``.
    """
    filled = records.withColumn("vector", F.coalesce(
        F.col("vector"), md5_vector(F.col("text"), dims)))
    top = F.lit(0) if existing is None else F.coalesce(
        existing.agg(F.max("id")).scalar(), F.lit(0))
    given = filled.filter(F.col("id").isNotNull())
    top = F.greatest(top, F.coalesce(given.agg(F.max("id")).scalar(), F.lit(0)))
    fresh = dense_row_number(filled.filter(F.col("id").isNull()), key, "_n")
    numbered = fresh.withColumn("id", top + F.col("_n")).drop("_n")
    return given.unionByName(numbered).drop(key)


def table_info(corpus: DataFrame) -> DataFrame:
    """Row count, vector sizes and number of categories of a vector table."""
    return corpus.agg(F.count("*").alias("row_count"), F.min(F.size("vector")).alias("min_dims"),
                      F.max(F.size("vector")).alias("max_dims"),
                      F.countDistinct("category").alias("categories"))


def table_samples(corpus: DataFrame, n: int = 3) -> DataFrame:
    """The first rows of a vector table by id."""
    return corpus.orderBy("id").limit(n)


def table_columns(corpus: DataFrame) -> DataFrame:
    """Schema of a vector table: every column's place, type and number of known values, from one pass."""
    fields = corpus.schema.fields
    counts = corpus.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(fields)])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
        F.col(f"_{i}").alias("known")) for i, f in enumerate(fields)])).alias("_c")).select("_c.*")


def table_list(spark: SparkSession, database: str) -> DataFrame:
    """The vector tables of a catalog database: name, rows, vector sizes and schema.

    Tables without an array column ``vector`` are left out. The driver reads the
    catalog only; the counts of all tables are one lazy plan.
    """
    found = []
    for name in sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary):
        held = spark.table(f"`{database}`.`{name}`")
        if "vector" in held.columns and isinstance(held.schema["vector"].dataType, ArrayType):
            found.append(held.agg(F.count("*").alias("row_count"), F.min(F.size("vector")).alias("min_dims"),
                                  F.max(F.size("vector")).alias("max_dims")).select(
                F.lit(name).alias("table_name"), "row_count", "min_dims", "max_dims",
                F.lit(held.schema.simpleString()).alias("schema")))
    if not found:
        return spark.createDataFrame([], "table_name STRING, row_count BIGINT, min_dims INT, max_dims INT, schema STRING")
    return reduce(DataFrame.unionAll, found)


def category_centroids(corpus: DataFrame, normalise: bool = False) -> DataFrame:
    """Mean vector (of the unit vectors if ``normalise``) and number of vectors per category.

    Every batch sums its own rows first; the shuffle carries one vector for each
    batch and category.
    """
    kind = corpus.schema["category"].dataType.simpleString()
    part = corpus.select("category", "vector").mapInArrow(
        kernels.batch_sums(normalise), f"category {kind}, total array<double>, size long")
    return part.groupBy("category").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("total")))).alias("total"),
        F.sum("size").alias("size")).select(
        "category", F.transform("total", lambda x: x / F.col("size")).alias("vector"), "size")


def _mean_unit(corpus: DataFrame) -> DataFrame:
    return category_centroids(corpus.withColumn("category", F.lit(0)), True)


def mean_similarity(corpus: DataFrame) -> DataFrame:
    """Mean cosine over all ordered pairs, from the squared norm of the mean unit vector.

    A row without length counts as similar to nothing, itself included.
    """
    whole = vec.dot(F.col("vector"), F.col("vector"))
    n = F.col("size").cast("double")
    return _mean_unit(corpus).select(
        F.col("size").alias("row_count"), whole.alias("mean_similarity"),
        F.try_divide(whole * n * n - n, n * (n - 1)).alias("mean_between_distinct"))


def mean_similarity_per_row(corpus: DataFrame) -> DataFrame:
    """Each row's mean cosine to all rows: its unit vector times the mean unit vector.

    The mean vector, one row, is computed first.
    """
    center = _mean_unit(corpus).collect()
    weights = np.array(center[0]["vector"] if center else [], dtype=float)
    return _scorable(corpus).mapInArrow(
        kernels.one_per_row("mean_similarity", lambda rows: kernels.units(rows) @ weights),
        "id long, mean_similarity double")


def similarity_blocks(corpus: DataFrame) -> DataFrame:
    """The all-pairs cosine matrix averaged over category blocks.

    The mean cosine between the rows of two categories equals the product of
    their mean unit vectors, so the cost is linear in the rows. The matrix of
    single rows would have their square as its size; ``query_product`` gives
    chosen lines of it.
    """
    centers = category_centroids(corpus, True)
    kind = centers.schema["category"].dataType.simpleString()
    out = None
    for others in in_blocks(centers, "category", BLOCK):
        part = centers.mapInArrow(kernels.products_with(
            [r["category"] for r in others], np.array([r["size"] for r in others]),
            np.array([r["vector"] for r in others])),
            f"category_a {kind}, category_b {kind}, pairs long, mean_similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def similarity_stats(corpus: DataFrame, queries: Mapping[str, Sequence[float]]) -> DataFrame:
    """Mean, highest below 1 and lowest similarity of every query to the corpus.

    Each batch sums up its own rows, so no pair leaves the task that scored it.
    """
    matrix = np.array(list(queries.values()), dtype=float)
    part = _scorable(corpus).mapInArrow(
        kernels.line_sums(list(queries), matrix),
        "query_id string, total double, n long, below_one double, least double")
    return part.groupBy("query_id").agg(
        (F.sum("total") / F.sum("n")).alias("mean_similarity"), F.max("below_one").alias("max_below_one"),
        F.min("least").alias("min_similarity"))


def norms(corpus: DataFrame) -> DataFrame:
    return _scorable(corpus).mapInArrow(kernels.one_per_row("norm", kernels.lengths),
                                        "id long, norm double")


def assign_nearest(corpus: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each row with its nearest centroid (``category, vector``), lowest category on ties.

    The centroids travel with the task, ``BLOCK`` of them at a time, and the
    nearest of all blocks counts. A row without a vector has a NULL cluster.
    """
    kind = centroids.schema["category"].dataType
    found = []
    for rows in in_blocks(centroids.select("category", "vector"), "category", BLOCK):
        if not rows:
            continue
        rows = sorted(rows, key=lambda r: (r["category"] is not None, r["category"]))
        find = kernels.nearest_udf(np.array([r["vector"] for r in rows], dtype=float))
        names = F.array(*[F.lit(r["category"]).cast(kind) for r in rows])
        place = f"_best{len(found)}"
        corpus = corpus.withColumn(place, find(F.col("vector")))
        found.append(F.struct(F.col(f"{place}.distance").alias("distance"),
                              F.get(names, F.col(f"{place}.place")).alias("cluster")))
    none = F.struct(F.lit(None).cast("double").alias("distance"), F.lit(None).cast(kind).alias("cluster"))
    best = F.array_min(F.array(*found)) if found else none
    return corpus.withColumn("_best", best).withColumns(
        {"cluster": F.col("_best.cluster"), "distance": F.col("_best.distance")}).drop(
        "_best", *[f"_best{i}" for i in range(len(found))])


def kmeans_clusters(corpus: DataFrame, k: int = 4, seed: int = 42):
    """k-means with at most as many clusters as rows: (rows with ``cluster``, centroids)."""
    k = min(k, corpus.limit(k).count())
    features = corpus.withColumn("_features", array_to_vector(F.col("vector")))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(features)
    centers = corpus.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "category INT, vector ARRAY<DOUBLE>")
    return model.transform(features).drop("_features"), centers


def kmeans_starts(corpus: DataFrame, k: int = 4, starts: int = 10, rounds: int = 30, seed: int = 42
                  ) -> tuple[DataFrame, DataFrame, list[float]]:
    """k-means from ``starts`` first sets of rows, advanced together: (rows, centroids, cost of each start).

    A round is one scan, whatever the number of starts: tasks sum up the rows
    of every start's centroids, and ``starts`` times ``k`` sums come back. The
    cheapest start counts, of equal ones the first. First centroids are rows
    chosen by a hash of id and start; an empty centroid stays where it is. Rows
    without a vector have no cluster.
    """
    rows = _scorable(corpus).where("vector IS NOT NULL")
    firsts = [[r["vector"] for r in rows.orderBy(F.xxhash64("id", F.lit(seed + s)), "id").limit(k).collect()]
              for s in range(starts)]
    if not firsts[0]:
        none = corpus.sparkSession.createDataFrame([], "category INT, vector ARRAY<DOUBLE>")
        return assign_nearest(corpus, none), none, []
    centers, cost = np.array(firsts, dtype=float), None
    for _ in range(rounds):
        moved = centers.copy()
        cost = np.zeros(starts)
        sums = [F.expr(f"sum(total[{i}])").alias(f"s{i}") for i in range(centers.shape[2])]
        for r in rows.mapInArrow(kernels.start_sums(centers), "start long, cluster long, size long, "
                                 "total array<double>, cost double").groupBy("start", "cluster").agg(
                F.sum("size").alias("size"), F.sum("cost").alias("cost"), *sums).collect():
            cost[r["start"]] += r["cost"]
            if r["size"]:
                moved[r["start"], r["cluster"]] = [r[f"s{i}"] / r["size"] for i in range(centers.shape[2])]
        done = np.allclose(moved, centers, rtol=0, atol=1e-9)
        if done:
            break
        centers = moved
    best = int(np.argmin(np.round(cost, 9)))
    centroids = corpus.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centers[best])], "category INT, vector ARRAY<DOUBLE>")
    return assign_nearest(corpus, centroids), centroids, [float(c) for c in cost]


def cluster_profile(clustered: DataFrame, means: Sequence[str], modes: Sequence[str],
                    sample: str, samples: int = 3) -> DataFrame:
    """Size, means, most frequent attributes and the first sample rows of each cluster.

    The rows are summed per combination of cluster and attributes first; sizes,
    means and modes all come from those sums.
    """
    base = clustered.groupBy("cluster", *modes).agg(
        F.count("*").alias("_n"),
        *[F.sum(F.col(m).cast("double")).alias(f"_sum_{m}") for m in means],
        *[F.count(m).alias(f"_count_{m}") for m in means])
    out = base.groupBy("cluster").agg(
        F.sum("_n").alias("size"),
        *[ratio(F.sum(f"_sum_{m}"), F.sum(f"_count_{m}")).alias(f"avg_{m}") for m in means])
    for column in modes:
        out = out.join(most_frequent(base, ["cluster"], column, f"dominant_{column}", "_n"),
                       "cluster")
    picked = top_n_per_group(clustered.select("cluster", "id", sample), ["cluster"],
                             [F.asc("id")], samples, F.col("id"))
    listed = picked.groupBy("cluster").agg(F.array_sort(F.collect_list(
        F.struct("rank", F.col(sample).cast("string").alias("s")))).alias("_s")).select(
        "cluster", F.array_join(F.col("_s.s"), ", ").alias("samples"))
    return out.join(listed, "cluster")


def principal_plane(corpus: DataFrame, k: int = 2):
    """Centred projection on the first ``k`` principal axes: (rows with ``point``, variance).

    Spark's model does not subtract the mean when it transforms, so the mean's
    own projection is taken off.
    """
    features = corpus.withColumn("_features", array_to_vector(F.col("vector")))
    model = PCA(k=k, inputCol="_features", outputCol="_point").fit(features)
    mean = features.agg(Summarizer.mean(F.col("_features")).alias("m")).first()["m"]
    shift = mean.toArray() @ model.pc.toArray()
    point = F.zip_with(vector_to_array("_point"), vec.literal_vector(shift.tolist()),
                       lambda x, m: x - m)
    rows = model.transform(features).withColumn("point", point).drop("_features", "_point")
    return rows, [float(v) for v in model.explainedVariance]


def flatten_image_metadata(images: DataFrame) -> DataFrame:
    """File name, joined tags, vector size and pixel size (0 where the JSON lacks it)."""
    parsed = images.withColumn("_m", F.from_json("metadata", "width BIGINT, height BIGINT"))
    return parsed.select(
        "id", "filename", F.array_join("tags", ", ").alias("tags"),
        F.size("vector").alias("vector_dim"),
        F.coalesce("_m.width", F.lit(0)).alias("width"),
        F.coalesce("_m.height", F.lit(0)).alias("height"))
