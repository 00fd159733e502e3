"""Scalar column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

MONEY = "decimal(12,2)"


def money(column: Column | str) -> Column:
    """Exact two-decimal amount; cast before arithmetic so sums carry no rounding error."""
    return _col(column).cast(MONEY)


def mean_of(total: Column, count: Column) -> Column:
    """Mean from an exact sum and a count: one division, hence the same on every plan."""
    return ratio(total, count)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL for a zero divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_change(current: Column, previous: Column) -> Column:
    """Growth in percent; NULL where the previous value is NULL or zero."""
    return ratio(current - previous, previous) * 100


def day_of_week(date: Column) -> Column:
    """Day of week with Sunday as 0 (Spark's own function starts at 1)."""
    return F.dayofweek(date) - 1


def trunc_date(unit: str, date: Column | str) -> Column:
    """``date_trunc`` that stays a DATE."""
    return F.date_trunc(unit, _col(date)).cast("date")


def bucket_label(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first upper bound (exclusive) the value falls under."""
    label = None
    for upper, name in bounds:
        test = value < upper
        label = F.when(test, name) if label is None else label.when(test, name)
    return F.lit(otherwise) if label is None else label.otherwise(otherwise)


def size_class(row_count: Column) -> Column:
    """Small below 1,000 rows, Medium below 10,000, else Large."""
    return bucket_label(row_count, [(1000, "Small"), (10000, "Medium")], "Large")


def json_int(document: Column | str, path: str) -> Column:
    """Integer at a JSON path; NULL where the path is missing or not a number."""
    return F.get_json_object(_col(document), path).try_cast("long")


def json_has(document: Column | str, path: str) -> Column:
    """1.0 where the JSON path holds a value, else 0.0."""
    return F.when(F.get_json_object(_col(document), path).isNotNull(), 1.0).otherwise(0.0)


def hash_pick(choices: Sequence[str], *keys: Column) -> Column:
    """A pseudo-random choice that depends on the keys alone, so a rerun repeats it."""
    options = F.array(*[F.lit(c) for c in choices])
    return F.element_at(options, hash_below(len(choices), *keys) + 1)


def hash_below(bound: int, *keys: Column) -> Column:
    """A pseudo-random integer in [0, bound) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(bound)).cast("int")


def md5_vector(text: Column, dims: int = 128) -> Column:
    """Deterministic text vector: the 16 MD5 bytes over 255, repeated to ``dims`` values.

    The digest is bound to a lambda variable, so it is computed once per text.
    """
    def cells(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(
            F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)

    once = F.transform(F.array(F.md5(text.cast("binary"))),
                       lambda digest: F.flatten(F.array_repeat(cells(digest), -(-dims // 16))))
    return F.slice(F.get(once, 0), 1, dims)


def not_in(column: Column, values: Sequence[object]) -> Column:
    """Negated membership that keeps rows whose value is NULL."""
    return column.isNull() | ~column.isin(*values)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
