"""Session settings and the shared folder used for checkpoints and staged tables."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores="*", shuffle_partitions=8, app="commentlake"):
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark):
    """The cluster's checkpoint folder; a temporary one only where none is set (local runs)."""
    held = spark.sparkContext.getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or held
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="commentlake-")
    if held is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark, name):
    """A fresh path below the shared folder, never reused by another run."""
    return f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"


def materialize(df):
    """Cut lineage with a reliable checkpoint, so that later reads see the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark):
    """Queries made here release their shuffle files when they end, not when the driver collects its garbage; the session's
    setting is put back."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def stored(df, path=None, mode="errorifexists"):
    """Cut lineage with a Parquet table in the shared folder, a fresh one without `path`."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "table")
    with releasing(spark):
        df.write.mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
