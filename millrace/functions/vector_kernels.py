"""Vector arithmetic on Arrow batches.

An ``array<float>`` column reaches Python as one flat buffer per batch, so numpy
works on it as a matrix. That is more than ten times faster than higher-order
SQL functions, which box every cell. Spark keeps the partitioning, and only the
vectors cross the process border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# Scores are rounded before they are ranked, so ranks do not hang on summation order.
SCORE_PLACES = 9


def as_matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """The vectors of a batch as rows of a matrix; all must have the same size."""
    if column.null_count:
        raise ValueError("a vector is NULL")
    if not len(column):
        return np.zeros((0, dims or 0))
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1 or (dims is not None and sizes != [dims]):
        raise ValueError(f"vectors of {sizes} cells where {dims or 'one size'} is wanted")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), sizes[0])


def present(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a batch are not NULL, and those as a matrix."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return known, as_matrix(column.drop_null() if column.null_count else column, dims)


def spread_out(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """Values of the rows that have a vector, NULL for the others."""
    if known.all():
        return pa.array(values)
    out = np.zeros(len(known), values.dtype)
    out[known] = values
    return pa.array(out, mask=~known)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = rows - query
    return np.einsum("ij,ij->i", gap, gap).round(SCORE_PLACES) + 0.0


def all_cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine similarity of each query (line) to each row; 0 where either has no length."""
    size = np.outer(lengths(queries), lengths(rows))
    dots = queries @ rows.T
    return np.divide(dots, size, out=np.zeros_like(dots), where=size > 0).round(SCORE_PLACES) + 0.0


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows over their length; a zero row stays zero."""
    size = lengths(rows)[:, None]
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _first(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least values, lowest id on ties, in that order."""
    if k < len(values):
        edge = np.partition(values, k - 1)[k - 1]
        places = np.flatnonzero(values <= edge)
    else:
        places = np.arange(len(values))
    return places[np.lexsort((ids[places], values[places]))[:k]]


def best_of_batch(names: list[str], queries: np.ndarray, k: int, by_distance: bool
                  ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keep each batch's ``k`` best rows (``id, vector``) per query; rows without a vector rank nowhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, rows = present(batch.column(1), queries.shape[1])
            if not len(rows):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[known]
            for name, query, near in zip(names, queries, all_cosines(rows, queries)):
                if by_distance:
                    gap = distances(rows, query)
                    order = _first(gap, ids, k)
                    gap = gap[order]
                else:
                    order = _first(-near, ids, k)
                    gap = distances(rows[order], query)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(order)), pa.array(ids[order]), pa.array(gap),
                     pa.array(near[order])], names=["query_id", "id", "distance", "similarity"])
    return run


def all_of_batch(names: list[str], queries: np.ndarray
                 ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Score each row (``id, vector``) against every query; NULL scores without a vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, rows = present(batch.column(1), queries.shape[1])
            for name, query, near in zip(names, queries, all_cosines(rows, queries)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(known), pa.string()), batch.column(0),
                     spread_out(distances(rows, query), known), spread_out(near, known)],
                    names=["query_id", "id", "distance", "similarity"])
    return run


def line_sums(names: list[str], queries: np.ndarray
              ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch and query: sum and number of similarities, the highest below 1 and the lowest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = present(batch.column(1), queries.shape[1])
            if not len(rows):
                continue
            near = all_cosines(rows, queries)
            below = np.where(near < 1.0, near, -np.inf).max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(near.sum(axis=1)), pa.array(np.full(len(names), len(rows))),
                 pa.array(below, mask=np.isinf(below)), pa.array(near.min(axis=1))],
                names=["query_id", "total", "n", "below_one", "least"])
    return run


def batch_sums(normalise: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vector sum and number of vectors per category (``category, vector``) of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode("encode")  # a null category is one as well
            known, rows = present(batch.column(1))
            if not len(rows):
                continue
            codes = coded.indices.to_numpy(zero_copy_only=False)[known]
            rows = units(rows) if normalise else rows
            sums = np.zeros((len(coded.dictionary), rows.shape[1]))
            np.add.at(sums, codes, rows)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(list(sums), pa.list_(pa.float64())),
                 pa.array(np.bincount(codes, minlength=len(sums)))],
                names=["category", "total", "size"])
    return run


def start_sums(centers: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For several sets of centres at once: size, vector sum and cost of each centre's rows (``id, vector``).

    One row per task, set and centre; a task holds the sums and one batch.
    """
    starts, k, dims = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total, cost = np.zeros((starts, k), np.int64), np.zeros((starts, k, dims)), np.zeros((starts, k))
        for batch in batches:
            _, rows = present(batch.column(1), dims)
            for s in range(starts):
                gaps = (rows ** 2).sum(axis=1)[:, None] - 2 * rows @ centers[s].T + (centers[s] ** 2).sum(axis=1)
                near = gaps.argmin(axis=1)
                size[s] += np.bincount(near, minlength=k)
                np.add.at(total[s], near, rows)
                np.add.at(cost[s], near, np.maximum(gaps[np.arange(len(rows)), near], 0.0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(starts), k)), pa.array(np.tile(np.arange(k), starts)),
             pa.array(size.ravel()), pa.array(list(total.reshape(-1, dims)), pa.list_(pa.float64())),
             pa.array(cost.ravel())], names=["start", "cluster", "size", "total", "cost"])
    return run


def products_with(names: list, sizes: np.ndarray, centers: np.ndarray
                  ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row (``category, vector, size``) times every centre: pairs of rows and dot product."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).type
            for i, row in enumerate(as_matrix(batch.column(1))):
                own = pa.repeat(batch.column(0)[i], len(names))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(names, kind), pa.array(sizes * batch.column(2)[i].as_py()),
                     pa.array(centers @ row)],
                    names=["category_a", "category_b", "pairs", "mean_similarity"])
    return run


def pairs_of_slices(terms: int, threshold: float, places: int, strip: int = 1024) -> Callable[[tuple, pa.Table], pa.Table]:
    """The pairs between two slices (one with itself, if equal) of the classes that hold a term in their prefix.

    A class's terms are numbered by rarity and those before the given one all lie in its
    prefix, so a pair that shares one of them is met there and left out here. What
    remains has its whole product in the given term and those after it.
    """
    def run(key: tuple, group: pa.Table) -> pa.Table:
        at, low, high = (k.as_py() for k in key)
        group = group.combine_chunks()
        ids, sizes, slices = (group.column(c).to_numpy() for c in ("class_id", "size", "slice"))
        listed = group.column("terms").combine_chunks()
        line = np.repeat(np.arange(len(ids)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        cells, held = np.zeros((len(ids), terms)), np.zeros((len(ids), terms), bool)
        cells[line, listed.flatten().to_numpy()] = group.column("weights").combine_chunks().flatten().to_numpy()
        held[line, listed.flatten().to_numpy()] = True
        rest, rarer = np.ascontiguousarray(cells[:, at:]), held[:, :at]
        first, second = np.flatnonzero(slices == low), np.flatnonzero(slices == high)
        found = []
        for start in range(0, len(first), strip):
            a = first[start:start + strip]
            b = second[start:] if low == high else second
            near = rest[a] @ rest[b].T
            i, j = np.nonzero(near >= threshold - 10.0 ** -places)
            close, i, j = near[i, j].round(places), a[i], b[j]
            kept = (i < j) if low == high else np.ones(len(i), bool)
            kept &= (close >= threshold) & (ids[i] != ids[j])
            i, j, close = i[kept], j[kept], close[kept]
            kept = np.concatenate([~(rarer[i[s:s + strip]] & rarer[j[s:s + strip]]).any(axis=1)
                                   for s in range(0, len(i), strip)] or [np.zeros(0, bool)])
            found.append((i[kept], j[kept], close[kept]))
        i, j, close = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        return pa.table([ids[i], ids[j], sizes[i], sizes[j], close],
                        names=["class_a", "class_b", "size_a", "size_b", "similarity"])
    return run


def one_per_row(name: str, kernel: Callable[[np.ndarray], np.ndarray]
                ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map ``id, vector`` to ``id`` and one double per row, NULL without a vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, rows = present(batch.column(1))
            values = kernel(rows) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), spread_out(values, known)],
                                             names=["id", name])
    return run


def nearest_udf(centers: np.ndarray) -> Callable[[Column], Column]:
    """A column function giving the position of the nearest centre and its distance; NULLs without a vector."""
    @F.arrow_udf("place int, distance double")
    def apply(vectors: pa.Array) -> pa.Array:
        known, rows = present(vectors, centers.shape[1])
        best = np.full(len(rows), np.inf)
        place = np.zeros(len(rows), dtype=np.int32)
        for i, center in enumerate(centers):  # keeps one distance column in memory, not all
            gap = distances(rows, center)
            closer = gap < best
            best[closer], place[closer] = gap[closer], i
        return pa.StructArray.from_arrays([spread_out(place, known), spread_out(best, known)],
                                          names=["place", "distance"])
    return apply
