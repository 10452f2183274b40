"""Timestamp parsing and calendar features; the session zone is expected to be UTC."""

from pyspark.sql import functions as F

from commentlake.functions.text import _col


def parse_timestamp(c):
    """ISO-8601 text with or without zone; unparsable text gives null."""
    return F.try_to_timestamp(_col(c))


def time_features(df, timestamp="timestamp"):
    day = F.weekday(_col(timestamp))
    return df.withColumns({
        "hour": F.hour(_col(timestamp)),
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
    })
