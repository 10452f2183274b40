"""Intermediate tables as Parquet in the shared folder: lineage ends there, and any executor can read them again."""

from commentlake.session import scratch_path

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df, *by):
    """The rows of df, written to the shared folder and read from there; with `by`, in a folder per value of these columns.

    Nothing behind the written table is read again, so the shuffle files of the write are released when it ends instead of
    waiting for the driver's garbage collection. The session's setting is put back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df, *names):
    """The names, with underscores put before them until none is a column of df (in any case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        out.append(name)
    return out
