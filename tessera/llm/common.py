"""What the training-data operators share: tables, shared scratch space, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: A word is a maximal run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch: texts are long, and two batches of a task are in memory at once on either side.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, so that a Python worker's memory stays bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a temp folder, in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tessera_scratch", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = sc._tessera_scratch = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return found.rstrip("/")


def scratch_paths(spark: SparkSession) -> list[str]:
    """The scratch paths of the session that are not deleted yet."""
    sc = spark.sparkContext
    if not hasattr(sc, "_tessera_paths"):
        sc._tessera_paths = []
    return sc._tessera_paths


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    scratch_paths(spark).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table stands for the shuffles that made it, so their files may go at once
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if path in scratch_paths(spark):
        scratch_paths(spark).remove(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def step(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What build() returns, written; the scratch tables that it made on the way are deleted."""
    before = len(scratch_paths(spark))
    done = materialise(build(), name)
    for path in scratch_paths(spark)[before:-1]:
        drop_path(spark, path)
    return done


def drop_tables(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, root)
