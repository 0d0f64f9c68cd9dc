"""Cutting lineage in iterative jobs: tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the one that spark.checkpoint.dir names; it can be removed once the application
    has ended. Where none is named, a local run gets a temporary one; a cluster's executors would not see it, so there it
    is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hypsoline-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found}/{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind, which Spark else keeps until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a table and read back: stable rows, no lineage, column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As cut, in as many buckets of `key` as shuffles have partitions: joins on it don't shuffle these rows again."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"hypsoline_{uuid.uuid4().hex}"
    with freed(spark):
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
