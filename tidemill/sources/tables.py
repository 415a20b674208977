"""Tables of a folder, and copies of a DataFrame in other formats."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views for SQL."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, removed when the driver's JVM ends.

    It is spark.checkpoint.dir; where that is unset, a temporary folder with a local master, and an error with any other.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: the lineage is cut, and a later join may split a skewed key."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def round_trip(df: DataFrame, kind: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write df as `kind` (csv, json, orc, parquet, text) and read it back with its schema.

    Partition columns stand last in what is read.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.format(kind).options(**options).partitionBy(*partition_by).save(path)
    return spark.read.format(kind).options(**options).schema(df.schema).load(path)
