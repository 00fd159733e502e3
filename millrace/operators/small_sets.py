"""Bringing a small set, or a larger one in blocks, to every row without a cross join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F


def as_array(small: DataFrame, max_rows: int) -> Column:
    """The rows of ``small`` as one array of structs, held by a scalar subquery.

    The size is checked: the subquery reads at most ``max_rows + 1`` rows and
    the query fails if there are more than ``max_rows``.
    """
    rows = small.limit(max_rows + 1).agg(F.collect_list(F.struct(*small.columns)).alias("rows"))
    checked = F.when(F.size("rows") > max_rows,
                     F.raise_error(F.lit(f"more than {max_rows} rows in a set meant to be small"))
                     ).otherwise(F.col("rows"))
    return rows.select(checked.alias("rows")).scalar()


def in_blocks(rows: DataFrame, key: str, size: int) -> Iterator[list[Row]]:
    """All rows in blocks of about ``size`` on the driver, one after another, dealt by a hash of the key.

    At least one block comes, empty if there is no row.
    """
    few = rows.limit(size + 1).collect()
    if len(few) <= size:
        yield few
        return
    n = -(-rows.count() // size)
    for i in range(n):
        yield rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i).collect()
