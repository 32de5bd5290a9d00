"""Sparse sets of non-negative integers as sorted arrays without repeats; each method is one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = -1


def members(values: Column) -> Column:
    """A set from any array: sorted, without repeats, nulls and negatives left out."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x >= 0))))


def add(s: Column, i: Column) -> Column:
    """With ``i``; a negative one raises."""
    i = F.when(i < 0, F.raise_error(F.lit("negative member"))).otherwise(i)
    return F.array_sort(F.array_union(s, F.array(i)))


def discard(s: Column, i: Column) -> Column:
    return F.array_remove(s, i)


def clear(s: Column, lo: Column, hi: Column) -> Column:
    """Without the members from ``lo`` up to but not ``hi``."""
    return F.filter(s, lambda x: (x < lo) | (x >= hi))


def within(s: Column, lo: Column, hi: Column) -> Column:
    return F.filter(s, lambda x: (x >= lo) & (x < hi))


def contains(s: Column, i: Column) -> Column:
    return F.array_contains(s, i)


def cardinality(s: Column) -> Column:
    return F.size(s)


def length(s: Column) -> Column:
    """The largest member plus one; 0 if empty."""
    return F.coalesce(F.array_max(s) + 1, F.lit(0))


def next_set(s: Column, i: Column) -> Column:
    return F.coalesce(F.array_min(F.filter(s, lambda x: x >= i)), F.lit(NONE))


def previous_set(s: Column, i: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(s, lambda x: x <= i)), F.lit(NONE))


def next_clear(s: Column, i: Column) -> Column:
    """The first integer from ``i`` on that is no member: one after the run of members that holds ``i``."""
    after = F.filter(s, lambda x: x >= i)
    gap = F.array_min(F.filter(F.transform(after, lambda x, k: F.struct((x - k) != i, i + k)), lambda t: t["col1"]))
    return F.coalesce(gap["col2"], i + F.size(after))


def previous_clear(s: Column, i: Column) -> Column:
    """The last integer up to ``i`` that is no member, -1 if there is none."""
    before = F.reverse(F.filter(s, lambda x: x <= i))
    gap = F.array_max(F.filter(F.transform(before, lambda x, k: F.struct((x + k) != i, i - k)), lambda t: t["col1"]))
    return F.coalesce(gap["col2"], i - F.size(before))


def both(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def either(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def without(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def flip(s: Column, i: Column) -> Column:
    return F.when(F.array_contains(s, i), F.array_remove(s, i)).otherwise(add(s, i))


def keep(s: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(s, test)


def total(s: Column, value: Callable[[Column], Column]) -> Column:
    """Sum of a function of the members, as a double."""
    return F.aggregate(s, F.lit(0.0), lambda t, x: t + value(x).cast("double"))


def ascending(s: Column, start: Column) -> Column:
    """Members from ``start`` on, in order."""
    return F.filter(F.array_sort(s), lambda x: x >= start)


def same(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def is_empty(s: Column) -> Column:
    return F.size(s) == 0


def clear_all(s: Column) -> Column:
    """The empty set."""
    return F.slice(s, 1, 0)


def walk_while(s: Column, test: Callable[[Column], Column], down: bool = False) -> Column:
    """The members in rising or falling order up to and with the first that fails the test."""
    ordered = F.reverse(F.array_sort(s)) if down else F.array_sort(s)
    fails = F.transform(ordered, lambda x: ~F.coalesce(test(x), F.lit(False)))
    stop = F.array_position(fails, True)
    return F.slice(ordered, F.lit(1), F.when(stop > 0, stop.cast("int")).otherwise(F.size(ordered)))


def total_long(s: Column, value: Callable[[Column], Column]) -> Column:
    """Sum of a function of the members, as a long."""
    return F.aggregate(s, F.lit(0).cast("bigint"), lambda t, x: t + value(x).cast("bigint"))


def total_int(s: Column, value: Callable[[Column], Column]) -> Column:
    """Sum of a function of the members in 32 bits, which wrap."""
    low = F.pmod(total_long(s, value) + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return low.cast("int")


def hashed(s: Column) -> Column:
    """A hash that equal sets share."""
    return F.xxhash64(F.array_sort(s))


def rows(df: DataFrame, s: str, member: str) -> DataFrame:
    """A row for each member of the set in column ``s``, for sets too large for one row."""
    return df.select(*(c for c in df.columns if c != s), F.explode(s).alias(member))
