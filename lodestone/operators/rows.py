"""Projection and filtering of single rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(c: Column, kind: T.DataType) -> Column:
    """Whether a value counts as true: not null, and not 0, '', false or an empty collection."""
    if isinstance(kind, T.BooleanType):
        t = c
    elif isinstance(kind, T.NumericType):
        t = c != 0
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        t = F.length(c) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        t = F.size(c) > 0
    else:
        t = c.isNotNull()
    return F.coalesce(t, F.lit(False))


def filter_rows(df: DataFrame, test: Column | str) -> DataFrame:
    """Rows for which a condition is true, or a column (by name) holds a true value."""
    if isinstance(test, str):
        return df.filter(truthy(F.col(test), df.schema[test].dataType))
    return df.filter(test)


def transform(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Sets a column and drops rows where it is null."""
    return df.withColumn(name, value).filter(F.col(name).isNotNull())


def function(df: DataFrame, name: str, value: Column, is_test: bool) -> DataFrame:
    """A test keeps rows where it is true or null; another function replaces the value, null keeping the old one."""
    if is_test:
        return df.filter(F.coalesce(value, F.lit(True)))
    return df.withColumn(name, F.coalesce(value, F.col(name)))


Fun = Callable[[Column], Column]


def compose(functions: Sequence[Fun] | Fun) -> Fun:
    """Functions applied from left to right."""
    if callable(functions):
        return functions

    def run(c: Column) -> Column:
        for f in functions:
            c = f(c)
        return c

    return run


def forward(c: Column) -> Column:
    """The value itself."""
    return c


def tuple_of(df: DataFrame, value: str | Sequence[str], functions: Sequence[Sequence[Fun] | Fun], names: Sequence[str]) -> DataFrame:
    """All functions of one column, or each of its own column; a list of functions is a composition."""
    sources = [value] * len(functions) if isinstance(value, str) else list(value)
    if not len(sources) == len(functions) == len(names):
        raise ValueError("as many columns as functions and names are needed")
    return df.select(*(compose(f)(F.col(s)).alias(n) for s, f, n in zip(sources, functions, names)))


def partition(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where test is true, and the others; the test is one column of a common plan."""
    d = df.withColumn("__test", F.coalesce(test, F.lit(False)))
    return d.filter("__test").drop("__test"), d.filter("not __test").drop("__test")


def assign(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds or replaces columns."""
    return df.withColumns(cols)


def extended_with(df: DataFrame, *names: str, **cols: Column) -> DataFrame:
    """Adds columns of 0.0 by name, and given ones; a name that exists is an error."""
    if clash := [n for n in (*names, *cols) if n in df.columns]:
        raise ValueError(f"columns exist: {clash}")
    return df.withColumns({**{n: F.lit(0.0) for n in names}, **cols})


def subdict(df: DataFrame, names: Sequence[str], strict: bool = True, default=None) -> DataFrame:
    """Columns by name; those missing are an error, or the default."""
    if strict and (missing := [n for n in names if n not in df.columns]):
        raise KeyError(", ".join(missing))
    return df.select(*(F.col(n) if n in df.columns else F.lit(default).alias(n) for n in names))


def lower_names(df: DataFrame) -> DataFrame:
    """Column names in lower case."""
    return df.toDF(*(c.lower() for c in df.columns))


def set_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Columns that are missing are added, nulls in others filled."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def get(df: DataFrame, name: str, default) -> Column:
    """A column's value, or the default where it isn't true."""
    return F.when(truthy(F.col(name), df.schema[name].dataType), F.col(name)).otherwise(F.lit(default))


def ufunc(df: DataFrame, f: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The same arithmetic on all (or the named) columns, names kept."""
    own = set(columns or df.columns)
    return df.select(*(f(F.col(c)).alias(c) if c in own else F.col(c) for c in df.columns))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows over all shuffle partitions, by a hash of columns: for functions that take long on rows of few bytes, which a task or two would read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def map_rows(df: DataFrame, f, schema) -> DataFrame:
    """A Python function of pandas batches, for what no expression can say."""
    return df.mapInPandas(f, schema)
