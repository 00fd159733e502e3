"""Highest and lowest entry of the cosine matrix of TF-IDF rows, exact, without forming the matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.text import TextModel, likely_pairs, line_of_weights, rarest_first, vector_classes
from millrace.sources.shared import shared_folder

#: Similarities are rounded to this many places; what rounds to one counts as one.
PLACES = 7
#: Classes are grouped by which of this many most frequent terms they hold: 2 ** 10 groups at most.
GROUPING_TERMS = 10


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def neighbour_floor(lines: DataFrame) -> float | None:
    """The highest similarity below one of classes next to each other in the order of their heaviest terms.

    A bound for what the highest of all pairs reaches at least. The order is
    laid out by ranges that the class id completes, so no range is hot.
    """
    def scored(batches) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column(0)) if last is None else np.vstack([last, _matrix(batch.column(0))])
            last = x[-1:]
            near = np.round((x[1:] * x[:-1]).sum(axis=1), PLACES)
            near = near[near < 1]
            if len(near):
                yield pa.RecordBatch.from_arrays([pa.array([near.max()])], names=["similarity"])

    at = F.transform("weights", lambda w, i: F.struct((-w).alias("less"), i.alias("at")))
    heaviest = F.transform(F.array_sort(F.filter(at, lambda e: e["less"] < 0)), lambda e: e["at"])
    ranged = lines.select(heaviest.alias("heaviest"), "class_id", "weights").repartitionByRange(
        "heaviest", "class_id").sortWithinPartitions("heaviest", "class_id")
    return ranged.select("weights").mapInArrow(scored, "similarity double").agg(F.max("similarity")).first()[0]


def _highest(classes: DataFrame, lines: DataFrame, model: TextModel) -> tuple[float | None, int]:
    """The highest similarity below one of two classes (none: no two share a term so), and how many pairs were scored.

    The neighbours' best is the threshold of one join, which then holds the best pair, unless no rounded
    similarity lies between it and one.
    """
    floor = neighbour_floor(lines)
    if floor is not None and floor > 1 - 1.5 * 10.0 ** -PLACES:
        return floor, 0
    pairs = likely_pairs(classes, model, max((floor or 0.0) - 2 * 10.0 ** -PLACES, 1e-6))
    near = F.round("similarity", PLACES)
    found = pairs.agg(F.max(F.when(near < 1, near)), F.count("*")).first()
    return found[0], found[1]


def _lowest(lines: DataFrame, n: int, holders: Sequence[int]) -> tuple[float, int]:
    """The lowest similarity of two of ``n`` classes, and how many pairs were scored to find it.

    ``holders`` counts the classes of each term. A class that shares its terms
    with fewer classes than there are shares none with some other: the lowest
    is 0, and counts alone prove it. Otherwise the line of the class of least
    reach bounds the lowest from above, classes are grouped by the most
    frequent terms they hold, the least weight of each term in a group bounds
    the similarity of two groups from below, and only pairs of groups that
    could go lower are scored.
    """
    others = F.array(*[F.lit(int(h) - 1) for h in holders])
    reach = F.aggregate(F.zip_with("weights", others, lambda w, h: F.when(w > 0, h).otherwise(0)),
                        F.lit(0).cast("bigint"), lambda s, x: s + x)
    least = lines.agg(F.min(F.struct(reach.alias("reach"), "class_id", "weights")).alias("least")).first()["least"]
    if least["reach"] < n - 1:
        return 0.0, 0
    lowest = lines.where(F.col("class_id") != least["class_id"]).agg(
        F.min(F.round(_dot(F.col("weights"), _literal(least["weights"])), PLACES))).first()[0]
    frequent = sorted(range(len(holders)), key=lambda i: (-holders[i], i))[:GROUPING_TERMS]
    group = sum((F.when(F.get("weights", F.lit(i)) > 0, 1 << bit).otherwise(0) for bit, i in enumerate(frequent)), F.lit(0))
    grouped = lines.withColumn("group", group)
    boxes = grouped.groupBy("group").agg(F.count("*").alias("n"), F.array(
        *[F.min(F.get("weights", F.lit(i))) for i in range(len(holders))]).alias("least")).collect()
    corner = np.array([b["least"] for b in boxes])
    open_pairs = [(boxes[i]["group"], boxes[j]["group"], boxes[i]["n"] * boxes[j]["n"])
                  for i, j in zip(*np.nonzero(np.triu(corner @ corner.T < lowest - 10.0 ** -PLACES)))]
    if not open_pairs:
        return lowest, n - 1
    wanted = lines.sparkSession.createDataFrame([p[:2] for p in open_pairs], "group_a INT, group_b INT")
    a, b = (grouped.select(*[F.col(c).alias(f"{c}_{side}") for c in ("group", "class_id", "weights")]) for side in "ab")
    met = a.join(wanted, "group_a").join(b, "group_b").where(
        (F.col("group_a") != F.col("group_b")) | (F.col("class_id_a") < F.col("class_id_b")))
    lower = met.agg(F.min(F.round(_dot(F.col("weights_a"), F.col("weights_b")), PLACES))).first()[0]
    return min(lowest, lower if lower is not None else lowest), n - 1 + sum(p[2] for p in open_pairs)


def similarity_extremes(weighted: DataFrame, key: str, model: TextModel) -> DataFrame:
    """One row over the cosine matrix of all rows, each with itself too: row_count, class_count, max_below_one,
    min_similarity, pairs_scored.

    Rows of equal weights are one class, whose rows have similarity one. A row
    without any term of the vocabulary, null and empty texts among them, has
    similarity 0 with every row and itself. ``max_below_one`` is null where all
    similarities are one, both extremes are where there is no row; a highest
    below a millionth counts as 0. ``pairs_scored`` counts the pairs that the
    joins handed on, without the neighbours that set the floor.
    """
    spark = weighted.sparkSession
    path, order = shared_folder(spark, "weight-classes"), rarest_first(model)
    vector_classes(weighted, key)[0].withColumn("weights", line_of_weights(order)).write.parquet(path)
    classes = spark.read.parquet(path)
    rows = weighted.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("weights"), F.lit(0)) <= 0).alias("bare")).first()
    n = classes.count()
    highest, lowest, scored = None, 1.0 if rows["n"] else None, 0
    if n > 1:
        lines = classes.select("class_id", "weights")
        held = {r["term"]: r["count"] for r in classes.select(F.explode("entries.term").alias("term")).groupBy("term").count().collect()}
        highest, scored = _highest(classes, lines, model)
        lowest, more = (0.0, 0) if rows["bare"] else _lowest(lines, n, [held.get(t, 0) for t in order])
        highest, scored = 0.0 if highest is None and lowest < 1 else highest, scored + more
    if rows["bare"]:
        highest, lowest = highest or 0.0, 0.0
    return spark.createDataFrame([(rows["n"], n, highest, lowest, scored)], "row_count long, class_count long, "
                                 "max_below_one double, min_similarity double, pairs_scored long")
