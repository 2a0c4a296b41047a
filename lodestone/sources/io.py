"""Sources and sinks."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collection(spark: SparkSession, items: Iterable, schema: str = "value bigint") -> DataFrame:
    """Items of a driver-side collection with `_pos` from 1; for small ones."""
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items, 1)]
    return spark.createDataFrame(rows, f"_pos bigint, {schema}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def const(spark: SparkSession, item, n: int) -> DataFrame:
    """item n times; for an endless stream see streaming.const_stream."""
    return spark.range(n).select((F.col("id") + 1).alias("_pos"), F.lit(item).alias("value"))


def numbers(spark: SparkSession, *args: int) -> DataFrame:
    """range(stop), (start, stop) or (start, stop, step)."""
    return spark.range(*args).withColumnRenamed("id", "value")


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Each row `times` times; `_copy` from 0."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("_copy", F.lit(0)).limit(0)


def generate(spark: SparkSession, n: int, fun, schema: str, tasks: int | None = None) -> DataFrame:
    """Rows of fun(i), lists of tuples or None, for i below n, made where they are used."""
    import pandas as pd

    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for i in pdf["id"] for r in (fun(int(i)) or [])], columns=names)

    return (spark.range(0, n, 1, tasks) if tasks else spark.range(n)).mapInPandas(run, schema)


# ---- piles: files that are read, or written and passed through


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = False, mode: str = "errorifexists") -> DataFrame:
    df.write.mode(mode).option("header", header).csv(path, sep=sep)
    return df


def save_text(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> DataFrame:
    """Writes a column as lines; df goes on, and is computed again unless it is cached."""
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)
    return df


def pile(spark: SparkSession, path: str, df: DataFrame | None = None, kind: str = "json", append: bool = False, schema: str | None = None) -> DataFrame:
    """Without df, reads the pile; with df, writes to it and gives back what was written."""
    if df is not None:
        df.write.mode("append" if append else "overwrite").format(kind).save(path)
        schema = schema or df.schema
    r = spark.read.format(kind)
    return (r.schema(schema) if schema else r).load(path)


def json_objects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line, blank lines between them."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    kind = schema or spark.read.json(path).schema
    return text.select(F.from_json("value", kind).alias("o")).select("o.*")


def globbed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern with * and ?, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or [])


def paged(spark: SparkSession, pattern: str, ids: Iterable[int] | None = None, start: int | None = None, stop: int | None = None, kind: str = "text", **options) -> DataFrame:
    """Pages pattern % i, stop included, or all there are; `_page` is the number."""
    if ids is None and start is not None and stop is not None:
        ids = range(start, stop + 1)
    rx = re.escape(pattern).replace("%d", r"(\d+)")
    if ids is None:
        found = [(int(m[1]), p) for p in globbed(spark, re.sub(r"%0?\d*d", "*", pattern)) if (m := re.search(rx + "$", p))]
        paths = [p for i, p in sorted(found) if start is None or i >= start]
    else:
        paths = [pattern % i for i in ids]
    d = spark.read.format(kind).options(**options).load(paths)
    tail = re.escape(os.path.basename(pattern)).replace("%d", r"(\d+)") + "$"
    return d.withColumn("_page", F.regexp_extract(F.input_file_name(), tail, 1).cast("int"))


def safe_rewrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a table on a file system of the driver: written beside it, then renamed; a failure leaves the old one."""
    new, old = f"{path}.rewrite-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.format(kind).save(new)
        had = fs.exists(fs_path(path))
        if had:
            fs.rename(fs_path(path), fs_path(old))
        if not fs.rename(fs_path(new), fs_path(path)):
            if had:
                fs.rename(fs_path(old), fs_path(path))
            raise OSError(f"{path} couldn't be replaced")
        if had:
            fs.delete(fs_path(old), True)
    finally:
        fs.delete(fs_path(new), True)


def files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, size, modified of files below a folder."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


# ---- Files of the notation


def read_notation(spark: SparkSession, path: str) -> DataFrame:
    """Files of the notation: path, _pos and each value as VARIANT.

    Spark reads the files, from any file system, each as a whole: a value may go
    over several lines.
    """

    def run(batches):
        import pandas as pd

        from ..functions import notation

        for pdf in batches:
            for p, text in zip(pdf["path"], pdf["text"]):
                yield pd.DataFrame([(p, i, notation.to_json(v)) for i, v in enumerate(notation.load(text), 1)], columns=["path", "_pos", "value"])

    return whole_files(spark, path).mapInPandas(run, "path string, _pos bigint, value string").withColumn("value", F.parse_json("value"))


def write_notation(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as a line of the notation."""
    from ..functions.notation import notation_encode

    df.select(notation_encode(F.to_json(F.struct(*df.columns))).alias("value")).write.mode(mode).text(path)


# ---- data bases


def literal(v) -> str:
    """A value as an SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        kind = "TIMESTAMP" if isinstance(v, dt.datetime) else "DATE"
        return f"{kind} '{v}'"
    return "'" + str(v).replace("'", "''") + "'"


def with_args(query: str, args: dict | list | None) -> str:
    """A statement with its arguments as literals; what is within quotes isn't a place for one."""
    if not args:
        return query
    rest = iter(args if not isinstance(args, dict) else ())

    def put(m: re.Match) -> str:
        if m["name"] and isinstance(args, dict):
            return literal(args[m["name"]])
        return literal(next(rest)) if m["place"] and not isinstance(args, dict) else m[0]

    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|::|:(?P<name>[A-Za-z_]\w*)|(?P<place>\?)", put, query)


class JsonDict:
    """A small dictionary of the driver, kept as one JSON file on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.values: dict = {}
        rows = spark.read.text(path, wholetext=True).collect() if self._fs().exists(self._file()) else []
        if rows:
            self.values = json.loads(rows[0]["value"])

    def _file(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self):
        return self._file().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def __getitem__(self, k):
        return self.values[k]

    def __setitem__(self, k, v):
        self.values[k] = v
        self.save()

    def __contains__(self, k):
        return k in self.values

    def save(self) -> None:
        out = self._fs().create(self._file(), True)
        try:
            out.write(bytearray(json.dumps(self.values).encode()))
        finally:
            out.close()


class DB:
    """SQL over registered tables, or over JDBC where a url is given."""

    def __init__(self, spark: SparkSession, url: str | None = None, **properties: str):
        self.spark, self.url, self.properties = spark, url, properties

    def select(self, query: str, args: dict | list | None = None) -> DataFrame:
        """Rows of a statement; args by name (:name) or place (?)."""
        if self.url:
            return self.spark.read.format("jdbc").option("url", self.url).options(**self.properties).option("query", with_args(query, args)).load()
        return self.spark.sql(query, args=args) if args else self.spark.sql(query)

    def execute(self, statement: str, args: dict | list | None = None) -> None:
        """Runs a statement that changes something, through the driver's connection where a url is given."""
        if not self.url:
            self.spark.sql(statement, args=args).collect() if args else self.spark.sql(statement).collect()
            return
        with self._connection() as c:
            c.createStatement().execute(with_args(statement, args))

    def execute_script(self, script: str) -> None:
        """Statements that end with semicolons, one after the other; semicolons within quotes end nothing."""
        for s in re.findall(r"(?:'(?:[^']|'')*'|\"[^\"]*\"|[^;'\"])+", script):
            if s.strip():
                self.execute(s.strip())

    @contextmanager
    def _connection(self):
        jvm = self.spark._jvm
        p = jvm.java.util.Properties()
        for k, v in self.properties.items():
            p.setProperty(k, v)
        if "driver" in self.properties:
            jvm.org.apache.spark.util.Utils.classForName(self.properties["driver"], True, False)
        c = jvm.java.sql.DriverManager.getConnection(self.url, p)
        try:
            yield c
        finally:
            c.close()

    def select_one(self, query: str, args: dict | list | None = None):
        return self.select(query, args).first()

    def count(self, table: str, where: str | None = None) -> int:
        d = self.table(table)
        return (d.filter(where) if where else d).count()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, name, properties=self.properties) if self.url else self.spark.table(name)

    def insert(self, table: str, df: DataFrame, attrs: Sequence[str] | None = None) -> None:
        """Appends the named columns."""
        d = df.select(*attrs) if attrs else df
        if self.url:
            d.write.mode("append").jdbc(self.url, table, properties=self.properties)
        else:
            d.write.mode("append").insertInto(table)

    def insert_rows(self, table: str, rows: Sequence[tuple], attrs: Sequence[str]) -> None:
        self.insert(table, self.spark.createDataFrame(rows, list(attrs)), attrs)

    def table_exists(self, name: str) -> bool:
        if not self.url:
            return self.spark.catalog.tableExists(name)
        with self._connection() as c:
            found = c.getMetaData().getTables(None, None, "%", None)
            while found.next():
                if found.getString("TABLE_NAME").lower() == name.lower():
                    return True
        return False
