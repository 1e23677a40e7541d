"""Model outputs that arrive as files: the batch parser on a stream, each id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluicework.operators.parsing import parse_outputs


def parsed_stream(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """(sample_id, parse_status, fields) of outputs that arrive under ``path`` as JSON lines with sample_id, raw_output, status
    and ts. An id that comes again within the watermark is dropped, so state is bounded by ``late``."""
    rows = spark.readStream.schema("sample_id long, raw_output string, status string, ts timestamp").json(path)
    once = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sample_id"])
    return parse_outputs(once, "sample_id", "raw_output", F.coalesce(F.col("status") == "generated", F.lit(False)))


def append_to(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
