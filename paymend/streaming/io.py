"""Stream sources and sinks, and running a stream over what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paymend.sources.scratch import home, scratch_dir


def file_events(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A table of the folder as a stream of files. Times become zoned, as watermarks require."""
    path = f"{folder.rstrip('/')}/{name}.parquet*"
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    zoned = {
        f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"
    }
    return stream.withColumns(zoned) if zoned else stream


def kafka_events(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from a broker, from the newest offset on; ``raw`` holds the envelope text.

    Needs the Kafka connector on the session's class path.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .load()
        .select(
            F.col("key").cast("string").alias("payment_id"),
            F.col("value").cast("string").alias("raw"),
            F.col("timestamp").alias("received_at"),
        )
    )


def keyed(df: DataFrame, key: str) -> DataFrame:
    """``key, value`` rows as a broker sink takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def kafka_sink(df: DataFrame, key: str, servers: str, topic: str, checkpoint: str):
    """Start writing a stream to a broker, keyed, at least once."""
    return (
        keyed(df, key)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def run_to_parquet(df: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an append stream over the available data and read the result back."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, label)
    running = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or scratch_dir(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_batches(
    df: DataFrame,
    step: Callable[[DataFrame, int], None],
    label: str,
    mode: str = "append",
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Run ``step`` on every micro-batch of the available data; returns the ended query."""
    running = (
        df.writeStream.foreachBatch(step)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint or home(df.sparkSession, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return running
