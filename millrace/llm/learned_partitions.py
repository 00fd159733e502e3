"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import written

#: The router is fitted on about this many distinct vectors, chosen by a hash.
SAMPLE = 12_000
#: Partitions of a small table; a large one gets one per 32 of the square root of its distinct vectors.
PARTITIONS = 32
#: Queries visit as many partitions as hold this share of the sample's own neighbours.
TARGET = 0.95
#: Rows of a partition that a task scores at once; larger partitions are dealt out.
BLOCK_ROWS = 16_384
_SLICES = 64
_QUERY_BATCH = 256
_MAX_PAIRS = 200_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product with each row, itself left out (fewer if there are fewer)."""
    k = min(k, len(x) - 1)
    found = np.empty((len(x), max(k, 0)), np.int64)
    for at in range(0, len(x) if k > 0 else 0, 1024):
        near = x[at:at + 1024] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        found[at:at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return found


def _halved(x: np.ndarray, rows: np.ndarray, low: int, high: int, out: np.ndarray) -> None:
    """Number ``rows`` low to high - 1 by repeated even cuts along the direction of widest spread."""
    if high - low == 1 or len(rows) == 0:
        out[rows] = low
        return
    centred = x[rows] - x[rows].mean(axis=0)
    widest = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    order, mid = np.argsort(centred @ widest, kind="stable"), (low + high) // 2
    cut = len(rows) * (mid - low) // (high - low)
    _halved(x, rows[order[:cut]], low, mid, out)
    _halved(x, rows[order[cut:]], mid, high, out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1,
                       sweeps: int = 30, seed: int = 7) -> np.ndarray:
    """Cut the graph into ``parts`` parts of at most (1 + slack) times the even size, with few edges cut.

    Starts from even cuts in space; then nodes move to the part that holds most
    of their neighbours (edges count both ways), the largest gains first, as
    long as it has room. Half of the willing nodes move in a sweep, so that
    neighbours don't swap places for ever.
    """
    n, rng = len(x), np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    _halved(x.astype(np.float64), np.arange(n), 0, parts, part)
    one = np.repeat(np.arange(n), graph.shape[1])
    ends, others = np.concatenate([one, graph.ravel()]), np.concatenate([graph.ravel(), one])
    room = math.ceil((1 + slack) * n / parts)
    for _ in range(sweeps):
        held = np.bincount(ends * parts + part[others], minlength=n * parts).reshape(n, parts)
        gain = held - held[np.arange(n), part][:, None]
        goal, best = gain.argmax(axis=1), gain.max(axis=1)
        order = np.argsort(-best, kind="stable")
        willing = order[(best[order] > 0) & (rng.random(n) < 0.5)]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in willing:
            if size[goal[i]] < room:
                size[part[i]] -= 1
                size[goal[i]] += 1
                part[i] = goal[i]
                moved += 1
        if moved <= n // 500:
            break
    return part


@dataclass
class Router:
    """A linear classifier over partitions, and how many partitions a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int
    expected: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit_router(x: np.ndarray, wanted: np.ndarray, epochs: int = 15, batch: int = 512, rate: float = 0.01,
               seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of softmax regression to the rows of ``wanted``, by Adam."""
    rng, n, scale = np.random.default_rng(seed), len(x), 1.0 / max(1e-12, float(np.sqrt((x * x).mean())))
    inputs = np.hstack([x * scale, np.ones((n, 1))])
    weights = np.zeros((inputs.shape[1], wanted.shape[1]))
    mean, square, step = np.zeros_like(weights), np.zeros_like(weights), 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at:at + batch]
            logits = inputs[rows] @ weights
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            grad, step = inputs[rows].T @ (chance - wanted[rows]) / len(rows), step + 1
            mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
            weights -= rate * (1 - epoch / epochs) * (mean / (1 - 0.9 ** step)) / (
                np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return weights[:-1] * scale, weights[-1]


def learn(x: np.ndarray, parts: int, k: int = 20, target: float = TARGET) -> Router:
    """Partition the neighbour graph of a sample and fit the router that stands for it.

    The classifier learns where a vector's neighbours lie, not where it lies
    itself. Rows are then filed under their likeliest partition, and ``probes``
    is the smallest number of partitions that holds the ``target`` share of the
    sample's neighbours so filed.
    """
    parts = max(1, min(parts, len(x) // 16))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1, 1.0)
    graph = neighbour_graph(x.astype(np.float32), k)
    part = balanced_partition(x, graph, parts)
    n = len(x)
    wanted = np.bincount(np.repeat(np.arange(n), graph.shape[1]) * parts + part[graph.ravel()],
                         minlength=n * parts).reshape(n, parts) / graph.shape[1]
    router = Router(*fit_router(x, wanted), 1, 0.0)
    scores = router.scores(x)
    filed, rank = scores.argmax(axis=1), np.empty((n, parts), np.int64)
    rank[np.arange(n)[:, None], np.argsort(-scores, axis=1, kind="stable")] = np.arange(parts)
    places = rank[np.arange(n)[:, None], filed[graph]]
    share = np.cumsum(np.bincount(places.ravel(), minlength=parts)) / places.size
    router.probes = min(parts, int(np.searchsorted(share, target)) + 1)
    router.expected = float(share[router.probes - 1])
    return router


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Return (gid, dims, v, ids) per distinct vector of (vec_id, v) rows: its ``keep`` smallest ids.

    A copy has its group's score, and ties go to smaller ids, so no query can
    need more of them. Ids are thinned in slices of a group first: a vector
    that a third of all rows share leaves ``keep`` ids per slice.
    """
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(_SLICES)))
    place = F.row_number().over(Window.partitionBy("v", "slice").orderBy("vec_id"))
    few = sliced.withColumn("place", place).where(F.col("place") <= keep).groupBy("v", "slice").agg(
        F.collect_list("vec_id").alias("ids"))
    whole = few.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    return written(whole.select(F.monotonically_increasing_id().alias("gid"), F.size("v").alias("dims"), "v", "ids"),
                   "ann-vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _routed(groups: DataFrame, router: Router) -> DataFrame:
    """Each vector filed under its likeliest partition; those asked for with the partitions to visit."""
    def batches(rows):
        for batch in rows:
            names = batch.schema.names
            if batch.num_rows == 0:
                continue
            scores = router.scores(_matrix(batch.column(names.index("v"))))
            order = np.argsort(-scores, axis=1, kind="stable")
            asked = batch.column(names.index("asked")).to_pylist()
            visits = [row[:router.probes].tolist() if a else None for row, a in zip(order, asked)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(order[:, 0], pa.int32()), pa.array(visits, pa.list_(pa.int32()))],
                names=[*names, "part", "visits"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return written(groups.mapInArrow(batches, f"{ddl}, part int, visits array<int>"), "ann-routed")


class _Cell:
    """The vectors of one block of a partition, and the rerank of queries against them."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.ready = False

    def add(self, gids: np.ndarray, vectors: np.ndarray, ids: pa.Array) -> None:
        self.parts.append((gids, vectors, ids.value_lengths().to_numpy(zero_copy_only=False),
                           ids.flatten().to_numpy(zero_copy_only=False)))

    def hits(self, gids: np.ndarray, queries: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
        """For each query the rows of its ``keep`` best vectors, scored in double precision, ties to smaller ids.

        A matrix product finds the candidates, with room for its rounding; each
        is then scored on its own, the same way in any batch. Where so many tie
        that they would take too much memory at once, queries go in halves.
        """
        if not self.parts:
            return
        if not self.ready:
            self.gids, self.vectors, self.lengths, self.ids = map(np.concatenate, zip(*self.parts))
            self.starts, self.ready = np.cumsum(self.lengths) - self.lengths, True
            self.longest = np.sqrt((self.vectors ** 2).sum(axis=1).max())
        near, n = queries @ self.vectors.T, len(self.gids)
        last = np.partition(near, n - min(keep, n), axis=1)[:, n - min(keep, n)]
        rounding = 1e-12 * self.longest * np.sqrt((queries ** 2).sum(axis=1))
        rows, cols = np.nonzero(near >= (last - rounding)[:, None])
        if len(rows) > _MAX_PAIRS and len(gids) > 1:
            half = len(gids) // 2
            yield from self.hits(gids[:half], queries[:half], keep)
            yield from self.hits(gids[half:], queries[half:], keep)
            return
        exact = (queries[rows] * self.vectors[cols]).sum(axis=1)
        order = np.lexsort((self.ids[self.starts[cols]], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(gids)))[rows] < keep
        rows, cols, exact = rows[best], cols[best], exact[best]
        lengths = self.lengths[cols]
        ends = np.cumsum(lengths)
        picks = np.arange(ends[-1]) - np.repeat(ends - lengths - self.starts[cols], lengths)
        offsets = np.concatenate([[0], ends[np.searchsorted(rows, np.arange(len(gids)), "right") - 1]])
        hits = pa.StructArray.from_arrays(
            [pa.array(np.repeat(-exact, lengths)), pa.array(self.ids[picks], pa.int64()),
             pa.array(np.repeat(self.gids[cols] == gids[rows], lengths))], names=["far", "vec_id", "own"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(gids), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)], names=["gid", "hits"])


def _rerank(routed: DataFrame, keep: int) -> DataFrame:
    """Return (gid, hits): per vector asked for its best rows in the partitions it visits.

    Partitions are dealt into blocks of about ``BLOCK_ROWS`` vectors by their
    sizes, one small number per partition. A query meets each block of its
    partitions; a task holds one block and streams the queries past it.
    """
    sizes = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = F.create_map(*[F.lit(x) for p, n in sorted(sizes.items()) for x in (p, -(-n // BLOCK_ROWS))])
    n_blocks = sum(-(-n // BLOCK_ROWS) for n in sizes.values())
    filed = routed.select("part", F.pmod(F.xxhash64("gid"), blocks[F.col("part")]).cast("int").alias("block"),
                          F.lit(0).alias("kind"), "gid", "v", "ids")
    visits = routed.where(F.col("visits").isNotNull()).select(
        F.explode("visits").alias("part"), "gid", "v").where(F.array_contains(F.map_keys(blocks), F.col("part")))
    asked = visits.select("part", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)).alias("block"),
                          F.lit(1).alias("kind"), "gid", "v", F.array().cast("array<bigint>").alias("ids"))
    spread = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = filed.unionByName(asked).repartition(max(spread, min(n_blocks, 20_000)), "part", "block")

    def batches(rows) -> Iterator[pa.RecordBatch]:
        cell = at = None
        for batch in rows:
            part, block, kind, gid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(part)]):
                if low == high:
                    continue
                if at != (part[low], block[low]):
                    cell, at = _Cell(), (part[low], block[low])
                vectors = _matrix(batch.column(4).slice(low, high - low))
                if kind[low] == 0:
                    cell.add(gid[low:high], vectors, batch.column(5).slice(low, high - low))
                    continue
                for q in range(0, high - low, _QUERY_BATCH):
                    yield from cell.hits(gid[low + q:low + min(high - low, q + _QUERY_BATCH)],
                                         vectors[q:q + _QUERY_BATCH], keep)

    met = cells.sortWithinPartitions("part", "block", "kind").mapInArrow(
        batches, "gid long, hits array<struct<far:double,vec_id:bigint,own:boolean>>")
    return met.groupBy("gid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, keep).alias("hits"))


def sample(groups: DataFrame, size: int) -> np.ndarray:
    """About ``size`` of the vectors, chosen and ordered by a hash of their components."""
    n = groups.count()
    mark = F.xxhash64("v", F.lit(5))
    share = min(1.0, size / max(1, n))
    rows = groups.where(F.pmod(mark, F.lit(1_000_000)) < int(share * 1_000_000)).select(mark.alias("mark"), "v")
    return np.array([r["v"] for r in sorted(rows.collect(), key=lambda r: (r["mark"], r["v"]))], np.float64)


def search(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
           partitions: int | None = None, target: float = TARGET, sample_size: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id ``every`` divides, candidates all rows but the
    query's own; nearness is the inner product of the vectors as they are, in
    double precision, nearest first, ties to the smaller id. Vectors that are
    null, empty, all zero or hold null, NaN or infinite components take no
    part, nor do rows without an id. Vectors are compared with those of their
    own length, each length with an index of its own. Rows that repeat an id
    are rows of their own: a query leaves out one row, its own.

    Equal vectors are searched once, as one, whether they ask or are asked for.
    The router is fitted on a hashed sample of ``sample_size`` distinct vectors;
    every vector is filed, and a query reranks all vectors of the ``probes``
    likeliest partitions. A table of few vectors has one partition and is
    searched in full.
    """
    keep = k + 1
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(
        F.col("vec_id").isNotNull() & _usable(F.col("v")))
    groups = distinct_vectors(rows, keep)
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumnRenamed("vec_id", "query_id")
    asking = written(asking.join(groups.select("gid", "v"), "v").select("query_id", "gid"), "ann-queries")
    wanted = asking.groupBy("gid").agg(F.lit(True).alias("asked"))
    groups = groups.join(wanted, "gid", "left")
    answers = None
    for row in groups.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect():
        own = groups.where(F.col("dims") == row["dims"])
        parts = partitions or max(PARTITIONS, math.isqrt(row["n"]) // 32)
        router = learn(sample(own, sample_size), parts, k, target)
        found = _rerank(_routed(own, router), keep)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    met = asking.join(answers, "gid")
    mine = F.array_position(F.transform("hits", lambda h: h["own"] & (h["vec_id"] == F.col("query_id"))), True)
    others = met.select("query_id", "hits", mine.alias("mine")).select("query_id", F.slice(F.filter(
        "hits", lambda h, i: i + 1 != F.col("mine")), 1, k).alias("hits"))
    return others.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.far")).alias("score"))
