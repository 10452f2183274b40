"""Landed reply pages as a stream: the continuous form of the page collector."""

from pyspark.sql import functions as F

from commentlake.functions.times import parse_timestamp
from commentlake.schema import REPLY_PAGE


def stream_replies(spark, path, late="1 hour"):
    """New replies as pages land; a reply seen again within `late` of its first arrival is dropped.

    The watermark follows the time of arrival, not the date of the reply, so a page of an older post is never late. It bounds
    the state that is kept.
    """
    pages = spark.readStream.schema(REPLY_PAGE).json(path)
    replies = pages.select(F.current_timestamp().alias("_landed"), F.inline("data"))
    return replies.withColumn("timestamp", parse_timestamp("timestamp")) \
        .withWatermark("_landed", late).dropDuplicatesWithinWatermark(["id"]).drop("_landed")


def write_replies(stream, path, checkpoint):
    """Append to a Parquet table until the pages at hand are used up; restartable from the checkpoint."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(path)
