"""Pipelines of stages, and parameter sweeps."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


class Pipeline:
    """A chain of stages; `p >> stage` gives a longer one, None and texts (comments) are no stages."""

    def __init__(self, *stages: Stage | str | None):
        self.stages: list[Stage] = [s for s in stages if s is not None and not isinstance(s, str)]
        if bad := [s for s in self.stages if not callable(s)]:
            raise TypeError(f"not a stage: {bad[0]!r}")

    def __rshift__(self, stage: Stage | str | None | Pipeline) -> Pipeline:
        return Pipeline(*self.stages, *(stage.stages if isinstance(stage, Pipeline) else [stage]))

    def __call__(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = df.transform(s)
        return df

    def observed(self, df: DataFrame):
        """The result, and an observation of the rows after each stage, to be read after an action."""
        from pyspark.sql import Observation

        seen = []
        for i, s in enumerate(self.stages):
            o = Observation(f"stage_{i}")
            df = df.transform(s).observe(o, F.count("*").alias("rows"))
            seen.append(o)
        return df, seen

    def fetch(self, df: DataFrame, n: int | None = None) -> list:
        """The first n rows of the result, or all."""
        out = self(df)
        return out.collect() if n is None else out.take(n)


def pipeline(*stages: Stage | str | None) -> Pipeline:
    return Pipeline(*stages)


def grid(params: Mapping[str, Iterable]) -> list[dict]:
    """All combinations; the last parameter changes fastest."""
    names = list(params)
    return [dict(zip(names, v)) for v in itertools.product(*(list(params[n]) for n in names))]


def grid_table(spark: SparkSession, params: Mapping[str, Sequence]) -> DataFrame:
    """The combinations as rows."""
    out = None
    for n, values in params.items():
        d = spark.createDataFrame([(v,) for v in values], [n])
        out = d if out is None else out.crossJoin(d)
    return out


class Space:
    """Values of a parameter: cast() takes the nearest, move() a neighbour, random() any."""

    def __init__(self, *values):
        if not values:
            raise ValueError("a space has one value at least")
        self.values = list(values)

    def cast(self, v):
        """v itself if it is in the space; else the nearest number, the first of equally near ones."""
        if v in self.values:
            return v
        return min(self.values, key=lambda x: abs(x - v))

    def move(self, v, step: int = 1):
        """The value `step` places after v, or the last (first) one there is."""
        i = self.values.index(self.cast(v)) + step
        return self.values[max(0, min(i, len(self.values) - 1))]

    def random(self, seed: int):
        import random

        return random.Random(seed).choice(self.values)


def sweep(df: DataFrame, params: Mapping[str, Iterable], metric: Callable[..., Column]) -> DataFrame:
    """A metric for each combination, from one scan: all are aggregates of one query. `metric(**params)` is an aggregate column."""
    combos = grid(params)
    names = list(params)
    one = df.agg(*(metric(**c).alias(f"m{i}") for i, c in enumerate(combos)))
    rows = F.array(*(F.struct(*(F.lit(c[n]).alias(n) for n in names), F.col(f"m{i}").alias("metric")) for i, c in enumerate(combos)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def sweep_runs(df: DataFrame, params: Mapping[str, Iterable], stage: Callable[..., DataFrame]) -> DataFrame:
    """stage(df, **params) for each combination, with its parameters as columns."""
    out = None
    for c in grid(params):
        d = stage(df, **c).withColumns({k: F.lit(v) for k, v in c.items()})
        out = d if out is None else out.unionByName(d)
    return out


def ensemble(*votes: Column) -> Column:
    """Mean of the votes that aren't null."""
    have = [F.when(v.isNotNull(), 1).otherwise(0) for v in votes]
    n = sum(have[1:], have[0])
    total = sum((F.coalesce(v, F.lit(0.0)) for v in votes[1:]), F.coalesce(votes[0], F.lit(0.0)))
    return F.when(n > 0, total / n)
