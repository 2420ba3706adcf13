"""Running a stream over what is there, with its state and output in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. The file source takes a pattern, so a single file serves as well as a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    is_dir = any(f.rsplit("/", 1)[0].endswith(f"{name}.parquet") for f in spark.read.parquet(f"{sf_dir}/{name}.parquet").inputFiles())
    path = f"{sf_dir}/{name}.parquet" if is_dir else f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as an instant (UTC). There is no watermark: a replay's files are in no order of time, and a watermark would drop what comes late."""
    return stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def appended(out: DataFrame) -> DataFrame:
    """Run to the end in append mode: each row is written once, exactly once across restarts."""
    spark, path = out.sparkSession, shared_path(out.sparkSession, "stream")
    q = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def completed(out: DataFrame) -> DataFrame:
    """Run to the end in complete mode: the last batch's table is the result."""
    spark, path = out.sparkSession, shared_path(out.sparkSession, "stream")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{epoch:08d}")

    q = out.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    done = max((p["batchId"] for p in q.recentProgress if p["numInputRows"] or p["batchId"] == last["batchId"]), default=0)
    return spark.read.schema(out.schema).parquet(f"{path}/{done:08d}")
