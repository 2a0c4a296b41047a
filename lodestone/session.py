"""Session factory and table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "lodestone", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master and partitions only where given, so spark-submit's settings stand."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        fixed["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**fixed, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    n = cpus or min(8, os.cpu_count() or 1)
    spark = session(f"local[{n}]", n, **{"spark.driver.memory": memory, "spark.ui.enabled": "false", **conf})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, as a lazy Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables, or of all."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
