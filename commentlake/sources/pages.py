"""Landed reply pages as a comment table."""

from pyspark.sql import functions as F

from commentlake.schema import REPLY_PAGE


def read_reply_pages(spark, path):
    return spark.read.schema(REPLY_PAGE).json(path)


def flatten_reply_pages(pages):
    """One row per reply; pages without data give none."""
    return pages.select(F.inline("data"))
