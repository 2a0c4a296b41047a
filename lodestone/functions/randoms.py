"""Random values as columns: each depends on a row's key, a seed and a path only, so results don't change with the partitioning.

Distributions nest: an outcome of Choice or Switch may be a distribution, and so
may the bounds of Interval and Range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Sequence[str], seed: int, path: str = "") -> Column:
    """A number in [0, 1)."""
    return F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(path)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


class Distribution:
    """column(key, seed) draws one value for each row."""

    def column(self, key: Sequence[str], seed: int = 0, path: str = "") -> Column:
        raise NotImplementedError


def draw(d: Any, key: Sequence[str], seed: int = 0, path: str = "") -> Column:
    """A value of a distribution, or a constant."""
    return d.column(key, seed, path) if isinstance(d, Distribution) else F.lit(d)


@dataclass
class Fixed(Distribution):
    """Always the same value."""

    value: Any

    def column(self, key, seed=0, path=""):
        return F.lit(self.value)


@dataclass
class Interval(Distribution):
    """A real number in [low, high)."""

    low: Any
    high: Any

    def column(self, key, seed=0, path=""):
        a, b = draw(self.low, key, seed, path + ".l"), draw(self.high, key, seed, path + ".h")
        return a + uniform(key, seed, path + ".u") * (b - a)


@dataclass
class Range(Distribution):
    """An integer from low to high, high not included."""

    low: Any
    high: Any
    step: int = 1

    def column(self, key, seed=0, path=""):
        a, b = draw(self.low, key, seed, path + ".l"), draw(self.high, key, seed, path + ".h")
        n = F.ceil((b - a) / F.lit(self.step))
        return (a + F.floor(uniform(key, seed, path + ".u") * n) * self.step).cast("bigint")


@dataclass
class Choice(Distribution):
    """One of several outcomes with given probabilities (rescaled), equal ones by default; outcomes are put in a fixed order."""

    outcomes: Sequence[Any]
    probs: Sequence[float] | None = None

    def __post_init__(self):
        if not self.outcomes or len({repr(o) for o in self.outcomes}) != len(self.outcomes):
            raise ValueError("outcomes must be there, each once")
        p = list(self.probs or [1.0] * len(self.outcomes))
        if len(p) != len(self.outcomes) or min(p) < 0 or sum(p) <= 0:
            raise ValueError("one probability for each outcome is needed")
        self.pairs = sorted(zip(self.outcomes, (x / sum(p) for x in p)), key=lambda x: repr(x[0]))

    def column(self, key, seed=0, path=""):
        u, total, out = uniform(key, seed, path + ".c"), 0.0, None
        for i, (o, p) in enumerate(self.pairs):
            total += p
            v = draw(o, key, seed, f"{path}.{i}")
            if i == len(self.pairs) - 1:
                return out.otherwise(v) if out is not None else v
            out = F.when(u < total, v) if out is None else out.when(u < total, v)


def switch(prob: float, on: Any, off: Any = None) -> Choice:
    """on with a probability, else off."""
    return Choice([on, off], [prob, 1 - prob])


@dataclass
class Intervals(Distribution):
    """A real number from one of several intervals, in proportion to their lengths or to given weights."""

    intervals: Sequence[tuple[float, float]]
    weights: Sequence[float] | None = None

    def column(self, key, seed=0, path=""):
        return Choice([Interval(*i) for i in self.intervals], self.weights or [b - a for a, b in self.intervals]).column(key, seed, path)


def weighted_index(weights: Sequence[float], key: Sequence[str], seed: int = 0) -> Column:
    """An index from 0, in proportion to the weights."""
    return Choice(list(range(len(weights))), weights).column(key, seed)


def record(fields: dict[str, Any], key: Sequence[str], seed: int = 0) -> Column:
    """A struct of independently drawn fields."""
    return F.struct(*(draw(d, key, seed, n).alias(n) for n, d in fields.items()))
