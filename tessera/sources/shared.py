"""Where tables and checkpoints that all executors must see are written."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task, on average, where all rows of a key meet.
TASK_ROWS = 500_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temp folder, in local mode only."""
    master = spark.sparkContext.master
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_tessera_shared", None)
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.sparkContext._tessera_shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def in_tasks(df: DataFrame, keys: str | list[str], counted: DataFrame | None = None) -> DataFrame:
    """df dealt by keys, TASK_ROWS rows a task on average or fewer, so that what a task sorts or groups doesn't grow with the table. The rows are those of df, or of a table that has as many."""
    keys = [keys] if isinstance(keys, str) else keys
    tasks = math.ceil((df if counted is None else counted).count() / TASK_ROWS)
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def with_checkpoints(df: DataFrame) -> DataFrame:
    """df, in a session that has a checkpoint folder: the configured one, or one of its own where none is set."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))
    return df


def as_table(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read again. A checkpoint keeps the size that Spark expects of the plan before it, a join's being the product of its sides': in a loop of joins that number itself
    takes several times the digits each round, until the driver can't hold it. A table has its own size; numbers lie in it as long as in memory, so that what Spark broadcasts by it is as small as it looks."""
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
