"""Bounded samples for fitting."""

from pyspark.sql import functions as F


def bounded_sample(df, rows, order):
    """At most `rows` rows, those with the least values of the hash column `order` (the order of df's rows does not count).

    A share of the hash range that holds about twice as many rows is cut out first, so that tasks send few rows to the driver
    however many there are; the share only saves work, as the least values lie in it.
    """
    n = df.count()
    low, high = -(1 << 63), (1 << 63) - 1
    cut = min(high, low + ((2 * rows + 200) << 64) // max(n, 1))
    return df.withColumn("_h", order).where(F.col("_h") <= F.lit(cut)).orderBy("_h").limit(rows).drop("_h")
