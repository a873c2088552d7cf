"""Streaming inserts: each micro-batch is assigned to fixed centroids and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..operators.cluster import insert


def stream_insert(spark: SparkSession, source: str, sink: str, checkpoint: str, megas: DataFrame, minis: DataFrame, schema: str = "vec_id long, embedding array<float>, label int") -> None:
    """Assign all files of a folder, available now, and append (vec_id, mega_id, mini_id, dist) to the sink, each batch once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        done = insert(df.select("vec_id", doubles("embedding").alias("e")), megas, minis)
        done.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a retry replaces its batch

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
