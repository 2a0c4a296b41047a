"""Explicit order: dense positions by key.

A DataFrame has no order, so order-sensitive operators take `order_by`, a list of
column names, "-name" for descending.  Positions count from 1.  Within partitions
(`partition_by`) they are a plain row_number.  Over a whole table rows are split
into ranges of the whole key, numbered within each range, and shifted by the
count of the ranges before, so no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
#: Rows sampled for each range when the key is cut into ranges.
SAMPLED = 20
_CUT = (T.NumericType, T.DateType, T.TimestampType, T.StringType, T.BooleanType)


def keys(order_by: Sequence[str]) -> list[Column]:
    """Sort expressions of names, "-name" being descending; nulls are lowest."""
    if not order_by:
        raise ValueError("order_by is needed: rows have no order of their own")
    return [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_first(k) for k in order_by]


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def _after(order_by: Sequence[str], kinds: list[T.DataType], bound: Sequence) -> Column:
    """Whether a row's key is at or after the bound."""
    k, b, kind = order_by[0], bound[0], kinds[0]
    c, v = F.col(f"`{k.lstrip('-')}`"), F.lit(b).cast(kind)
    over = c.isNotNull() if b is None else c > v
    if k.startswith("-"):
        over = F.lit(False) if b is None else c.isNull() | (c < v)
    over = F.coalesce(over, F.lit(False))
    same = c.eqNullSafe(v)
    return over | (same if len(bound) == 1 else same & _after(order_by[1:], kinds[1:], bound[1:]))


def _range(order_by: Sequence[str], kinds: list[T.DataType], cuts: list[tuple], first: int = 0) -> Column:
    """The number of cuts at or before a row's key, by binary search."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(_after(order_by, kinds, cuts[m]), _range(order_by, kinds, cuts[m + 1 :], first + m + 1)).otherwise(_range(order_by, kinds, cuts[:m], first))


def _cuts(df: DataFrame, order_by: Sequence[str], ranges: int) -> list[tuple]:
    """ranges - 1 keys that cut the table, from a sample that a hash of the key chooses; any keys give right positions."""
    names = [k.lstrip("-") for k in order_by]
    d = df.select(*(F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)))
    some = d.orderBy(F.xxhash64(*d.columns)).limit(SAMPLED * ranges)  # a heap of so many rows in each task
    rows = [tuple(r) for r in some.orderBy(*keys([f"-k{i}" if k.startswith("-") else f"k{i}" for i, k in enumerate(order_by)])).collect()]
    step = max(1, len(rows) // ranges)
    return list(dict.fromkeys(rows[step::step]))[: ranges - 1]


def with_pos(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] | None = None, name: str = POS, ranges: int | None = None) -> DataFrame:
    """df with the position of each row, from 1; ties are numbered in some order unless order_by is unique.

    A column of df with this name is replaced.
    """
    order = keys(order_by)
    if partition_by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order)))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # keys are cut by their leading columns that have literals of their own
    kinds = [df.schema[k.lstrip("-")].dataType for k in order_by]
    lead = next((i for i, k in enumerate(kinds) if not isinstance(k, _CUT)), len(kinds))
    cuts = _cuts(df, order_by[:lead], n) if n > 1 and lead else []
    range_, row, before_, count_ = free([*df.columns, name], "range", "row", "before", "count")
    rows = df.withColumn(range_, _range(order_by[:lead], kinds[:lead], cuts))
    count = rows.groupBy(range_).agg(F.count("*").alias(count_))
    before = count.select(range_, (F.sum(count_).over(Window.orderBy(range_)) - F.col(count_)).alias(before_))  # one row for each range
    # each range to a partition of its own: by their hashes some would share one
    numbered = rows.repartitionById(n, F.col(range_)).withColumn(row, F.row_number().over(Window.partitionBy(range_).orderBy(*order)))
    return numbered.join(F.broadcast(before), range_).withColumn(name, F.col(row) + F.col(before_)).drop(range_, row, before_)
