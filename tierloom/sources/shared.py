"""The folder that driver and executors share, and keyed tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a kept table; a run rewrites those that its keys fall into.
BUCKETS = 64


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset a local master gets a temporary folder and any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tierloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)
    return path


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, path: str, key: str, order: list[Column], buckets: int = BUCKETS) -> DataFrame:
    """Merge rows into the table at ``path`` and read it back: one row of each key, the last by ``order``.

    The table lies in folders by bucket of the key. Only buckets that the new rows' keys fall into are read and written: their new
    files are staged and take the old ones' place when the job commits, so a failed run leaves the table as it was.
    Rows with a null key are one key. The first run makes the table.
    """
    spark = rows.sparkSession
    new = rows.withColumn("__bucket", _bucket(F.col(key), buckets))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(jvm_path) and len(fs.listStatus(jvm_path)) > 0
    if there:
        touched = [r["__bucket"] for r in new.select("__bucket").distinct().collect()]
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("__bucket").isin(touched))
        new = old.unionByName(new)
    columns = rows.columns
    last = new.groupBy(key, "__bucket").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select("row.*", "__bucket")
    last.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(path)
    return spark.read.schema(new.schema).parquet(path).select(*columns)
