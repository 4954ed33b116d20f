"""Event detection over signal files that keep arriving.

The batch operator is applied to each new set of files as a unit (a file holds
whole runs), detections are appended under their batch id, and the response
matrix is rolled up from the detections.  A batch that is retried after a failure
replaces its own part only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pathloom.operators import signals as Sg


def detect_arrivals(spark: SparkSession, source: str, schema: str | StructType, keys: list[str],
                    out: str, state: str, baseline=Sg.BASELINE_MS, response=Sg.RESPONSE_MS,
                    threshold: float = Sg.THRESHOLD) -> StreamingQuery:
    """Process all files not seen before, then stop.  ``state`` is the stream's own folder."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = Sg.detect_events(batch, keys, baseline, response, threshold)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(handle)
            .option("checkpointLocation", state).trigger(availableNow=True).start())


def detections(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def current_matrix(spark: SparkSession, out: str, stim: str, observed: str) -> DataFrame:
    """Response matrix over everything detected so far."""
    return Sg.response_matrix(detections(spark, out).withColumn(
        "onset", F.col("onset").cast("double")), stim, observed)
