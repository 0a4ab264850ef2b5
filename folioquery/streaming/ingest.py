"""Micro-batches of new documents and verdicts from files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.plans.model import segments


def document_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def passages(stream: DataFrame) -> DataFrame:
    """Passages of arriving documents; no state is held."""
    return segments(stream)


def verdict_counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Verdicts by window and kind; rows later than ``late`` behind the newest are dropped.
    stream: ts, verdict."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "verdict").agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, folder: str, checkpoint: str):
    """Append each batch under its own number: a batch that is run again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
