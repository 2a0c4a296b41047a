"""Chaining, merging, mixing, sampling and sorting of tables."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..order import keys


def chain(*sources: DataFrame) -> DataFrame:
    """Rows of all sources; `_src` is the number of the source, which comes first in the order."""
    return reduce(DataFrame.unionByName, [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)])


def flatten(df: DataFrame, column: str, deep: bool = True) -> DataFrame:
    """Elements of lists, and of the lists in them, as rows; with deep=False one level only.  A null list has no rows, a null element is a row."""
    kind = df.schema[column].dataType
    c = F.col(column)
    while deep and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(F.filter(c, lambda x: x.isNotNull())), kind.elementType
    return df.withColumn(column, F.explode(c))


def merge_sort(*sources: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Sources merged in key order; of equal keys, the earlier source first."""
    return chain(*sources).orderBy(*keys(order_by), "_src")


def heap_merge(*labelled: tuple[DataFrame, str], order_by: Sequence[str]) -> DataFrame:
    """Sources merged in key order with a `label` of their own."""
    return reduce(DataFrame.unionByName, [d.withColumn("label", F.lit(x)) for d, x in labelled]).orderBy(*keys(order_by), "label")


def top_k(df: DataFrame, k: int, order_by: Sequence[str]) -> DataFrame:
    """The k first rows by key: a heap in each task, then one merge."""
    return df.orderBy(*keys(order_by)).limit(k)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.unionByName(b).distinct()


def uniform(key: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only, whatever the partitioning."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def sample(df: DataFrame, share: float, key: Sequence[str], seed: int = 0) -> DataFrame:
    """A share of the rows, chosen by a hash of their key."""
    return df.filter(uniform(key, seed) < share)


def draw(df: DataFrame, n: int, key: Sequence[str], weight: str | None = None, seed: int = 0) -> DataFrame:
    """n rows drawn with replacement, in proportion to their weight; `_draw` numbers them from 0.

    A draw falls into a bucket of rows (by a hash of the key) in proportion to
    the bucket's weight, and then on a row of it.  In each bucket draws and ends
    of cumulative weights are sorted together, and a draw takes the next end: the
    work is that of one sort of rows and draws.  A column `_draw` is replaced.
    """
    own, n_buckets = [c for c in df.columns if c != "_draw"], 1024
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.select(F.struct(*own).alias("row"), w.alias("w"), F.xxhash64(*key, F.lit(seed)).alias("h"), F.struct(*key).alias("k")).filter("w > 0").withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("int"))
    sums = rows.groupBy("bucket").agg(F.sum("w").alias("s"))
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = sums.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("from_"), F.col("s").alias("weight"), F.sum("s").over(every).alias("total"), F.lead("bucket").over(Window.orderBy("bucket")).isNull().alias("last"))  # 1,024 rows
    u = F.col("u") * F.col("total")
    draws = df.sparkSession.range(n).select(F.col("id").alias("_draw"), uniform(["id"], seed + 1).alias("u"))
    placed = draws.join(F.broadcast(edges), (u >= F.col("from_")) & (F.col("last") | (u < F.col("from_") + F.col("weight")))).select("bucket", "_draw", (u - F.col("from_")).alias("at"))
    ends = rows.withColumn("at", F.sum("w").over(Window.partitionBy("bucket").orderBy("h", "k", F.xxhash64("row"))))
    both = ends.select("bucket", "at", "row", F.lit(None).cast("bigint").alias("_draw")).unionByName(placed.select("bucket", "at", F.lit(None).cast(ends.schema["row"].dataType).alias("row"), "_draw"))
    # an end is after the draws below it; a draw at an end takes the row after
    later = Window.partitionBy("bucket").orderBy(F.desc("at"), F.col("_draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("bucket").orderBy(F.col("at"), F.col("_draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("next", F.last("row", ignorenulls=True).over(later))
    # rounding may put a draw behind the last end of its bucket
    hit = hit.withColumn("row", F.coalesce("next", F.last("row", ignorenulls=True).over(past))).filter("_draw is not null")
    return hit.select("_draw", "row.*")


def mix(sources: Sequence[DataFrame], probs: Sequence[float], order_by: Sequence[str], seed: int = 0) -> DataFrame:
    """Random interleaving: draw number i takes the next row of a source chosen by probs; ends before the first draw from a source that has none left.

    Which source each draw takes is a hash of its number.  Draws are counted by
    block of numbers and source, so that each block is numbered on its own; a
    source's r-th row meets its r-th draw in an equi-join.
    """
    from ..order import with_pos

    total, block = sum(probs), 1 << 16
    counts = [s.count() for s in sources]
    n = sum(counts) + 1
    u = uniform(["id"], seed)
    choice = F.lit(len(probs) - 1)
    for i in reversed(range(len(probs) - 1)):
        choice = F.when(u < sum(probs[: i + 1]) / total, i).otherwise(choice)
    draws = sources[0].sparkSession.range(n).select(F.col("id").alias("_draw"), choice.alias("_src"), F.floor(F.col("id") / block).alias("_block"))
    per_block = draws.groupBy("_src", "_block").agg(F.count("*").alias("_n"))
    before = per_block.select("_src", "_block", (F.sum("_n").over(Window.partitionBy("_src").orderBy("_block")) - F.col("_n")).alias("_before"))  # a row for 65,536 draws
    draws = draws.withColumn("_row", F.row_number().over(Window.partitionBy("_src", "_block").orderBy("_draw"))).join(before, ["_src", "_block"])
    draws = draws.select("_draw", "_src", (F.col("_row") + F.col("_before")).alias("_pos"))
    short = reduce(lambda a, b: a | b, [(F.col("_src") == i) & (F.col("_pos") == c + 1) for i, c in enumerate(counts)])
    end = draws.filter(short).agg(F.coalesce(F.min("_draw"), F.lit(n)).alias("_end"))
    rows = reduce(DataFrame.unionByName, [with_pos(s, order_by).withColumn("_src", F.lit(i)) for i, s in enumerate(sources)])
    return draws.crossJoin(F.broadcast(end)).filter("_draw < _end").join(rows, ["_src", "_pos"]).drop("_end", "_pos")


def partial_sort(df: DataFrame, size: int, value: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Sorting with a buffer of `size` rows: each new row takes the place of the buffer's smallest, which goes out.

    By definition sequential: one task for each group of partition_by (all rows, without).  `_rank` is the new order.
    """
    names = [k.lstrip("-") for k in order_by]
    up = [not k.startswith("-") for k in order_by]
    schema = df.withColumn("_rank", F.lit(0).cast("bigint")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ascending=up, kind="stable").reset_index(drop=True)
        heap, out = [], []
        for i, v in enumerate(pdf[value].tolist()):
            if len(heap) < size:
                heapq.heappush(heap, (v, i))
            else:
                out.append(heapq.heapreplace(heap, (v, i))[1] if size else i)
        out += [i for _, i in sorted(heap)]
        r = pdf.iloc[out].reset_index(drop=True)
        r["_rank"] = range(len(r))
        return r

    grouped = df.groupBy(*partition_by) if partition_by else df.groupBy(F.lit("all rows"))
    return grouped.applyInPandas(run, schema)
