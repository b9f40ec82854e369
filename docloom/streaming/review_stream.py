"""The corrections summary kept up to date over a folder of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import review_log


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    return review_log.parse(spark.readStream.text(folder))


def start_summary(spark: SparkSession, folder: str, name: str, checkpoint: str) -> StreamingQuery:
    """A query in complete mode that keeps the summary in the memory table `name`."""
    out = review_log.summary(corrections(spark, folder))
    return out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
