"""Running a stream over the data that is there, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcgraph.stage import Stage


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in append mode; the emitted rows as a table.

    Windows still open at the final watermark are not part of it.
    """
    spark: SparkSession = stream.sparkSession
    root = Stage(spark, name).root
    run = (
        stream.writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
        .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
