"""Stages that watch rows and let them through, and materialization."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..order import keys


def print_rows(df: DataFrame, n: int = 20, order_by: Sequence[str] | None = None, out: Callable[[str], object] | None = None) -> DataFrame:
    """Prints the first n rows (in key order, if one is given), and gives df back."""
    top = df.orderBy(*keys(order_by)) if order_by else df
    for r in top.take(n):
        (out or (lambda s: print(s, file=sys.stdout)))(", ".join(f"{c}={r[c]}" for c in df.columns))
    return df


def print_subset(df: DataFrame, every: int, order_by: Sequence[str], n: int = 20, out: Callable[[str], object] | None = None) -> DataFrame:
    """Prints every every-th row, n of them at most, and gives df back."""
    from .sequence import subset

    print_rows(subset(df, every, order_by), n, order_by, out)
    return df


def buffered(df: DataFrame) -> DataFrame:
    """The rows, computed once and read by all that follows, from the checkpoint folder that the session names."""
    return df.checkpoint(eager=True)


class Report:
    """Counts the rows that pass, and times the action that makes them pass.

        r = Report("clean")
        r.watch(df).write.parquet(path)
        r.report()   # {"rows": ..., "seconds": ...}
    """

    def __init__(self, name: str = "report"):
        self.name = name

    def watch(self, df: DataFrame) -> DataFrame:
        self.seen, self.began = Observation(self.name), time.monotonic()
        return df.observe(self.seen, F.count("*").alias("rows"))

    def report(self) -> dict:
        """Waits for the action to end."""
        rows = self.seen.get["rows"]
        return {"rows": rows, "seconds": time.monotonic() - self.began}
