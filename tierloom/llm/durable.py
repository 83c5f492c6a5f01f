"""Tables written to the folder that driver and executors share.

Operators cut lineage here: what is written survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to a Python worker while a table is written: texts may be long.
BATCH_ROWS = 1024
HOT_GROUPS = 1000
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; any other master is refused, since its
    executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tierloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def drop_table(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _filesystem(spark, path)
    fs.delete(jvm_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are dropped at its end, but for those of :func:`lasting`."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            drop_table(spark, path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, jvm_path = _filesystem(spark, path)
    # the path has to exist to be registered
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)
    return path


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; returns what was written and its path.

    The files go when the driver's JVM ends, or earlier by :func:`drop_table`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    fs, jvm_path = _filesystem(spark, path)
    fs.deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path), path


def adopt(path: str) -> None:
    """Let what lies at ``path`` go with the scope around the caller, if there is one."""
    if scopes := _scopes.get():
        scopes[-1].append(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table that goes with the scope around it."""
    table, path = write_table(df, label)
    adopt(path)
    return table


def lasting(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table that outlives the innermost scope: what an operator returns from one."""
    table, path = write_table(df, label)
    if len(scopes := _scopes.get()) > 1:
        scopes[-2].append(path)
    return table


def hash_blocks(rows: int, per_block: int) -> int:
    """How many hash blocks keep about ``per_block`` rows in each; grows with the input."""
    return max(1, -(-int(rows) // per_block))


def joined_where_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``groups`` on ``key``; rows of a hot group are joined where they lie.

    ``groups`` has one row for each key and how many rows have it in ``size``. Of groups that hold more than one
    in ``HOT_GROUPS`` of all rows there are fewer than that, so they can be broadcast at any scale.
    """
    hot = groups.filter(F.col(size) * HOT_GROUPS > n_rows)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)
