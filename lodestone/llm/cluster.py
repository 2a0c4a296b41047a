"""Session helpers of this subpackage: written intermediate tables and column checks."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_S = 5.0


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_.isDefined():
            return set_.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has already ended
        pass


_cleaned = 0.0


def _clean(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffles that nothing refers to; at most once in CLEAN_S seconds, as it collects garbage for that."""
    global _cleaned
    if time.monotonic() - _cleaned >= CLEAN_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _cleaned = time.monotonic()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there.

    This cuts the lineage: a lost executor costs only the tasks that it ran, and
    shuffle files of what led here can be cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    schema = df.schema
    del df
    _clean(spark)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table of stored(), once all that is made from it has been written or collected."""
    for path in df.inputFiles()[:1]:
        folder = path.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1].startswith("stored-"):
            _remove(df.sparkSession, folder)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def need(df: DataFrame, *names: str) -> None:
    """Raises ValueError where df lacks one of the columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until none of the columns has it, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def docs_of(df: DataFrame, *more) -> DataFrame:
    """doc_id as bigint, text as string, and further names or Columns; other columns are left out."""
    need(df, "doc_id", "text", *(m for m in more if isinstance(m, str)))
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
