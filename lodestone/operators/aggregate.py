"""Folds over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..order import free, keys


def mean(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, sample deviation and count of the values that aren't null."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("dev"), F.count(value).alias("n"))


def metric(df: DataFrame, value: Column, aggregate, name: str = "metric", by: Sequence[str] = ()) -> DataFrame:
    """A value of each row, nulls left out, folded by an aggregate function."""
    return df.withColumn("__m", value).filter("__m is not null").groupBy(*by).agg(aggregate(F.col("__m")).alias(name))


def weighted_mean(value: str, weight: str, start: float = 0.0, start_weight: float = 0.0) -> Column:
    """(v0*w0 + sum(v*w)) / (w0 + sum(w)); null where the weights add up to 0."""
    ok = F.col(value).isNotNull() & F.col(weight).isNotNull()
    top = F.lit(start * start_weight) + F.coalesce(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.lit(0.0))
    low = F.lit(float(start_weight)) + F.coalesce(F.sum(F.when(ok, F.col(weight))), F.lit(0.0))
    return F.when(low != 0, top / low)


def accumulate_2d(patches: DataFrame, x: str, y: str, values: str, weights: str | None = None, prior: float = 0.001) -> DataFrame:
    """Weighted mean of overlapping patches at (x, y); values, and weights if any, are arrays of rows."""
    cells = patches.select(x, y, F.posexplode(values).alias("dy", "row"), *([F.col(weights).alias("w")] if weights else []))
    cells = cells.select((F.col(y) + F.col("dy")).alias("yy"), x, F.posexplode("row").alias("dx", "v"), *([F.element_at("w", F.col("dy") + 1).alias("wrow")] if weights else []), "dy")
    w = F.element_at("wrow", F.col("dx") + 1) if weights else F.lit(1.0)
    return cells.select((F.col(x) + F.col("dx")).alias("x"), F.col("yy").alias("y"), "v", w.alias("w")).groupBy("x", "y").agg((F.sum(F.col("v") * F.col("w")) / (F.lit(prior) + F.sum("w"))).alias("value"), F.sum("w").alias("weight"))


def min_max(value: str, arg: str | None, pos: str) -> list[Column]:
    """min, max, argmin, argmax, idxmin, idxmax; the first of equal values counts, pos gives the order; without arg the index stands for it."""
    v, p = F.col(value), F.col(pos)
    lo, hi = F.when(v.isNotNull(), F.struct(v, p)), F.when(v.isNotNull(), F.struct(v, -p))
    a = F.col(arg) if arg else p
    return [F.min(v).alias("min"), F.max(v).alias("max"), F.min_by(a, lo).alias("argmin"), F.max_by(a, hi).alias("argmax"), F.min_by(p, lo).alias("idxmin"), F.max_by(p, hi).alias("idxmax")]


def likelihood(prob: str, log: bool = True, exp: bool = False) -> Column:
    """Mean logarithm of probabilities (or of values that are logarithms already), or its exponential."""
    m = F.avg(F.ln(prob) if log else F.col(prob))
    return F.exp(m) if exp else m


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """min, max, population deviation, median and sum of a column."""
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"), F.sum(value).alias("sum"))


def unique(df: DataFrame, value: str, order_by: Sequence[str]) -> DataFrame:
    """Distinct values in the order in which they first occur; of values that occur first at the same place, the lower one first."""
    names = [k.lstrip("-") for k in order_by]
    d = df.select(F.col(value).alias("v"), *(F.col(n).alias(f"k{i}") for i, n in enumerate(names)))
    sort = [f"-k{i}" if k.startswith("-") else f"k{i}" for i, k in enumerate(order_by)]
    if len(names) == 1:
        first = d.groupBy("v").agg((F.max if sort[0][0] == "-" else _min_null_lowest)("k0").alias("k0"))
    elif not any(k[0] == "-" for k in sort):
        # structs compare key by key, nulls lowest
        first = d.groupBy("v").agg(F.min(F.struct(*sort)).alias("k")).select("v", "k.*")
    else:
        w = Window.partitionBy("v").orderBy(*keys(sort))
        first = d.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return first.orderBy(*keys(sort), "v").select(F.col("v").alias(value))


def _min_null_lowest(name: str) -> Column:
    """The lowest value, which is null if any is."""
    return F.min(F.struct(name))[name]


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once, and how often."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def count_within(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, by: str) -> DataFrame:
    """ranges with `n`, the number of points of the same group whose value is from low to high, where there are any.

    Pairs aren't made: a range's number is the difference of two running counts,
    of points up to its high end and of those below its low end.  Equal values,
    and equal ranges, of a group are one row there.
    """
    kind = ranges.schema[low].dataType
    g, lo, hi, n = free(ranges.columns, "_g", "_lo", "_hi", "n")
    none = F.lit(None).cast(kind)
    same = points.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast(kind).alias("v")).agg(F.count("*").alias("n"))
    asked = ranges.filter((F.col(low) <= F.col(high)) & F.col(by).isNotNull()).select(F.col(by).alias("g"), F.col(low).alias("lo"), F.col(high).alias("hi")).distinct()
    rows = same.select("g", "v", F.lit(1).alias("side"), "n", none.alias("lo"), none.alias("hi"))
    for end, side in (("lo", 0), ("hi", 2)):  # at equal values below the points, or above
        rows = rows.unionAll(asked.select("g", F.col(end).alias("v"), F.lit(side).alias("side"), F.lit(0).cast("bigint").alias("n"), "lo", "hi"))
    run = rows.withColumn("run", F.sum("n").over(Window.partitionBy("g").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0)))
    found = run.filter("side <> 1").groupBy(F.col("g").alias(g), F.col("lo").alias(lo), F.col("hi").alias(hi)).agg(F.sum(F.when(F.col("side") == 2, F.col("run")).otherwise(-F.col("run"))).alias(n)).filter(F.col(n) > 0)
    return ranges.join(found, (ranges[by] == found[g]) & (ranges[low] == found[lo]) & (ranges[high] == found[hi])).drop(g, lo, hi)


def total(df: DataFrame) -> DataFrame:
    """Number of rows."""
    return df.agg(F.count("*").alias("n"))


def stats(df: DataFrame, name: str):
    """df with an observation of its row count; the second value answers after an action."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows")), o


def weighted_mse(pred: str, truth: str, weight: str) -> Column:
    """Weighted mean squared error."""
    return F.sum(F.pow(F.col(pred) - F.col(truth), 2) * F.col(weight)) / F.sum(weight)


def weighted_accuracy(pred: str, truth: str, weight: str) -> Column:
    """Weighted share of equal labels."""
    return F.sum(F.when(F.col(pred) == F.col(truth), F.col(weight)).otherwise(0.0)) / F.sum(weight)
