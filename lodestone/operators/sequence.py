"""Order-sensitive operators: each takes order_by, and most an optional partition_by."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..order import POS, free, keys, with_pos


def offset(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Rows after the first n, in order; by positions, as Spark's own offset takes the whole table through one task."""
    (pos,) = free(df.columns, POS)
    return with_pos(df, order_by, name=pos).filter(F.col(pos) > n).orderBy(pos).drop(pos)


def limit(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows; 0 gives none."""
    return df.orderBy(*keys(order_by)).limit(n)


def slice_rows(df: DataFrame, start: int, stop: int | None, step: int, order_by: Sequence[str], partition_by: Sequence[str] | None = None) -> DataFrame:
    """Rows start, start + step, ... before stop, counted from 0."""
    if start < 0 or step < 1:
        raise ValueError("start must not be negative, step at least 1")
    (pos,) = free(df.columns, POS)
    d = with_pos(df, order_by, partition_by, pos)
    p = F.col(pos) - 1
    keep = (p >= start) & ((p - start) % step == 0)
    return d.filter(keep if stop is None else keep & (p < stop)).drop(pos)


def subset(df: DataFrame, fraction: int, order_by: Sequence[str], partition_by: Sequence[str] | None = None) -> DataFrame:
    """Every fraction-th row: number n, 2n, 3n, ..."""
    (pos,) = free(df.columns, POS)
    return with_pos(df, order_by, partition_by, pos).filter(F.col(pos) % fraction == 0).drop(pos)


def _first_failing(df: DataFrame, test: Column, order_by: Sequence[str], partition_by: Sequence[str] | None) -> tuple[DataFrame, str, str]:
    """Positions, and the first position where test isn't true (null: none), with the names of both columns."""
    pos, stop = free(df.columns, POS, "_stop")
    fails = F.when(~F.coalesce(test, F.lit(False)), F.col(pos))
    d = with_pos(df, order_by, partition_by, pos)
    if partition_by:
        return d.withColumn(stop, F.min(fails).over(Window.partitionBy(*partition_by))), pos, stop
    one = d.agg(F.min(fails).alias(stop))
    return d.crossJoin(F.broadcast(one)), pos, stop  # a single row


def take_while(df: DataFrame, test: Column, order_by: Sequence[str], partition_by: Sequence[str] | None = None) -> DataFrame:
    """Rows before the first for which test isn't true."""
    d, pos, stop = _first_failing(df, test, order_by, partition_by)
    return d.filter(F.col(stop).isNull() | (F.col(pos) < F.col(stop))).drop(pos, stop)


def drop_while(df: DataFrame, test: Column, order_by: Sequence[str], partition_by: Sequence[str] | None = None) -> DataFrame:
    """Rows from the first for which test isn't true."""
    d, pos, stop = _first_failing(df, test, order_by, partition_by)
    return d.filter(F.col(pos) >= F.col(stop)).drop(pos, stop)


def stop_on(df: DataFrame, test: Column, order_by: Sequence[str], partition_by: Sequence[str] | None = None) -> DataFrame:
    """Rows before the first for which test is true."""
    return take_while(df, ~F.coalesce(test, F.lit(False)), order_by, partition_by)


def loop(df: DataFrame, times: int) -> DataFrame:
    """All rows, times over; `_iter` numbers the rounds from 0."""
    return df.crossJoin(F.broadcast(df.sparkSession.range(times).withColumnRenamed("id", "_iter")))


def batch(df: DataFrame, size: int | None, value: str, order_by: Sequence[str], partition_by: Sequence[str] | None = None) -> DataFrame:
    """Consecutive rows as lists of `size` values (`_batch`, `items`); the last may be shorter, None makes one list, no rows give none."""
    d = with_pos(df, order_by, partition_by)
    by = [F.col(c) for c in partition_by or ()]
    number = F.lit(0).cast("bigint") if size is None else F.floor((F.col(POS) - 1) / F.lit(size)).cast("bigint")
    g = d.groupBy(*by, number.alias("_batch")).agg(F.array_sort(F.collect_list(F.struct(POS, F.col(value).alias("v")))).alias("s"))
    return g.select(*by, "_batch", F.transform("s", lambda s: s["v"]).alias("items"))


def as_list(df: DataFrame, value: str, order_by: Sequence[str]) -> DataFrame:
    """All values as one list (`items`), in order."""
    (pos,) = free(df.columns, POS)
    pairs = with_pos(df, order_by, name=pos).select(F.col(pos).alias("p"), F.col(value).alias("v"))
    return pairs.agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("s")).select(F.transform("s", lambda s: s["v"]).alias("items"))


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], mode: str = "long", fill: dict | None = None) -> DataFrame:
    """Rows side by side by position.  long: missing sides are null or fill; short: the common length; strict: an error if lengths differ."""
    if mode not in ("long", "short", "strict"):
        raise ValueError(f"unknown mode {mode}")
    a, b = with_pos(left, left_order), with_pos(right, right_order)
    out = a.join(b, POS, "inner" if mode == "short" else "full")
    if mode == "strict":
        na, nb = left.agg(F.count("*").alias("__a")), right.agg(F.count("*").alias("__b"))
        same = F.when(F.col("__a") == F.col("__b"), True).otherwise(F.raise_error(F.lit("zip: lengths differ")).cast("boolean"))
        out = out.crossJoin(na).crossJoin(nb).filter(same).drop("__a", "__b")
    return out.fillna(fill) if fill else out


def split_where(df: DataFrame, cut: Callable[[Column, Column], Column], value: str, order_by: Sequence[str], partition_by: Sequence[str] | None = None) -> DataFrame:
    """Runs of rows, a new one wherever cut(previous, current) holds: `_run` from 0, `start` and `stop` positions from 0, `size`."""
    d = with_pos(df, order_by, partition_by)
    by = list(partition_by or ())
    # over a whole table the running sum is one ordered pass; give partition_by where the table is large
    w = Window.partitionBy(*by).orderBy(POS)
    prev = F.lag(value).over(w)
    flag = F.when(F.coalesce(cut(prev, F.col(value)), F.lit(False)), 1).otherwise(0)
    d = d.withColumn("__cut", flag).withColumn("_run", F.sum("__cut").over(w))
    return d.groupBy(*by, "_run").agg((F.min(POS) - 1).alias("start"), F.max(POS).alias("stop"), F.count("*").alias("size"))


def ntile(df: DataFrame, n: int, order_by: Sequence[str], name: str = "tile") -> DataFrame:
    """The number, from 1, of each row's share of n that are as large as possible alike, the first ones by one row larger."""
    pos, all_ = free([*df.columns, name], POS, "_total")
    d = with_pos(df, order_by, name=pos).crossJoin(F.broadcast(df.agg(F.count("*").alias(all_))))  # a single row
    p, size, more = F.col(pos) - 1, F.expr(f"{all_} div {n}"), F.col(all_) % n
    large = more * (size + 1)
    tile = F.when(p < large, F.floor(p / (size + 1))).otherwise(more + F.floor((p - large) / size)) + 1
    return d.withColumn(name, tile.cast("int")).drop(pos, all_)


def enumerate_limit(df: DataFrame, n: int, order_by: Sequence[str], start: int = 0, name: str = "i") -> DataFrame:
    """The first n rows, numbered from start."""
    top = limit(df, n, order_by)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*keys(order_by))) - 1 + start)  # n rows only


def count_rows(df: DataFrame, order_by: Sequence[str], name: str = "n", partition_by: Sequence[str] | None = None) -> DataFrame:
    """Running number of each row."""
    return with_pos(df, order_by, partition_by, name)


def progress(df: DataFrame, order_by: Sequence[str], name: str = "percent") -> DataFrame:
    """Share of the rows up to each row, in percent."""
    pos, all_ = free([*df.columns, name], POS, "_total")
    total = df.agg(F.count("*").alias(all_))
    return with_pos(df, order_by, name=pos).crossJoin(F.broadcast(total)).withColumn(name, F.lit(100.0) * F.col(pos) / F.col(all_)).drop(pos, all_)
