"""Centroid clustering over integer vectors, in built-in expressions with literal centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import written

SCALE = 64
#: Components beyond this would overflow a squared distance of some hundred components in 64 bits.
MAX_COMPONENT = 1 << 27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Return (vec_id, q, own): floor(64 * x) of every component, and the sum of their squares.

    Kept are vectors of exactly ``dims`` components, none null, NaN or infinite;
    other columns are ignored. Repeated rows are vectors of their own, and a
    null id is kept. A component beyond ``MAX_COMPONENT`` is an error, since no
    64-bit distance could hold its square.
    """
    def unfit(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(SCALE))
        return F.when(F.abs(scaled) > float(MAX_COMPONENT), F.raise_error(F.lit(
            "a vector component is too large for 64-bit distances")).cast("long")).otherwise(F.floor(scaled))

    source = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return source.where((F.size("v") == dims) & ~F.exists("v", unfit)).select(
        "vec_id", F.transform("v", whole).alias("q")).select("vec_id", "q", squares(F.col("q")).alias("own"))


def first_centroids(points: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The ``k`` vectors whose ``seed:vec_id`` has the smallest SHA-256, in that order.

    Rows that repeat an id follow in the order of their vectors; rows without
    an id are not chosen. Fewer vectors give fewer centroids.
    """
    named = points.where(F.col("vec_id").isNotNull()).select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    return [list(r["q"]) for r in named.orderBy("h", "q").limit(k).collect()]


def _longs(values: Iterable[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def squares(q: Column) -> Column:
    return F.aggregate(q, F.lit(0).cast("long"), lambda whole, x: whole + x * x)


def distance(q: Column, own: Column, centroid: Sequence[int]) -> Column:
    """The squared Euclidean distance to a literal centroid, given the vector's own sum of squares.

    Written as x.x + c.c - 2 x.c, which is exact in integers and costs one
    product per component; the literal array holds -2c.
    """
    literal = _longs(-2 * c for c in centroid)
    return F.aggregate(F.zip_with(q, literal, lambda x, c: x * c),
                       own + F.lit(sum(c * c for c in centroid)).cast("long"), lambda whole, part: whole + part)


def nearest(q: Column, own: Column, centroids: Sequence[Sequence[int]]) -> Column:
    """A struct (distance, cluster) of the nearest centroid; of equal ones the smallest number."""
    return F.array_min(F.array(*[F.struct(distance(q, own, c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids)]))


def updated(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid moved to the floor of its vectors' componentwise mean; an empty one stays.

    One pass: a sum per cluster and component, combined before the shuffle, so
    that a row per task and cluster moves and one row per cluster comes back.
    """
    dims = len(centroids[0])
    near = nearest(F.col("q"), F.col("own"), centroids)["cluster"]
    sums = points.select(near.alias("cluster"), "q").groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.expr(f"sum(q[{i}])").alias(f"s{i}") for i in range(dims)])
    moved = list(centroids)
    for row in sums.collect():
        moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return moved


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1,
            key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Assign every vector to one of ``k`` centroids after ``rounds`` updates.

    Returns vec_id, cluster, distance (squared, in units of 1/64), the distance
    summed over the cluster (cluster_inertia) and over all vectors (inertia),
    and the SHA-256 of the final centroid's components, joined by commas. What
    is kept and how repeats and nulls count, says ``integers``. No vector, no
    row. Only centroids and their sums, bounded by ``k`` and ``dims``, reach
    the driver; no vector is shuffled.
    """
    spark = vectors.sparkSession
    points = written(integers(vectors, dims, key, vector), "integer-vectors")
    centroids = first_centroids(points, k, seed)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = updated(points, centroids)
    assigned = written(points.select("vec_id", nearest(F.col("q"), F.col("own"), centroids).alias("near")).select(
        "vec_id", "near.cluster", "near.distance"), "integer-clusters")
    spread = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(
        F.sum("distance").alias("total")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per_cluster = _longs(spread.get(i, 0) for i in range(len(centroids)))
    return assigned.select(
        "vec_id", "cluster", "distance", F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, marks)), F.col("cluster")).alias("centroid_sha256"))


def sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """The same in SQL over the table ``embeddings``."""
    steps = [f"""
    v AS (SELECT row_number() OVER () AS r, vec_id,
                 [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
          FROM embeddings WHERE len(embedding) = {dims}
            AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
             SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v WHERE vec_id IS NOT NULL
             ORDER BY h, q LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS (SELECT v.r, v.vec_id, v.q, min([CAST(list_sum(
                 [(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.q, t.q)]) AS BIGINT), t.c]) AS m
             FROM v CROSS JOIN c{i} AS t GROUP BY v.r, v.vec_id, v.q)""")
        if i < rounds:
            steps.append(f"""
    s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (
               SELECT m[2] AS c, unnest(q) AS x, unnest(range({dims})) AS i FROM a{i}) GROUP BY c, i),
    n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{i} GROUP BY c),
    c{i + 1} AS (SELECT c{i}.c, coalesce(n{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN n{i} ON c{i}.c = n{i}.c)""")
    return f"""WITH {','.join(steps)}
    SELECT a{rounds}.vec_id, CAST(m[2] AS INTEGER) AS cluster, CAST(m[1] AS BIGINT) AS distance,
           CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
           CAST(sum(m[1]) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(t.q, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} AS t ON t.c = m[2]"""
