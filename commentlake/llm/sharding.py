"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from pyspark.sql import Window, functions as F

PREFIX = 7  # hex digits of the shuffle key that choose a bucket
BUCKET_ROWS = 20_000


def _bucket_count(df, n):
    """Buckets are only a way of dealing rows to tasks; ranks are exact for any number."""
    per_task = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * per_task, n // BUCKET_ROWS + 1)


def _before(n, order, *group):
    """Sum over the earlier buckets (of the group)."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(w), F.lit(0))


def interleave(df, n_shards=16, id_col="doc_id", stratum="source", seed="shard-1", ties=()):
    """Add `shard` and `slot`: contiguous cuts of the rows ordered by fractional rank within their stratum.

    Rows of a stratum are shuffled by md5(seed:id); row r of n gets the fraction (r + 0.5) / n. Every prefix of the order by
    fraction holds each stratum in proportion, so every shard matches the mixture and shard sizes differ by one row at most.
    `slot` counts from 0 inside a shard. `ties` are further columns that order rows with equal ids.

    Null strata are one stratum of their own and a null id hashes as an empty one; repeated rows are placed one by one; no
    rows give no rows; columns named like `shard`, `slot` or starting with `_il_` are replaced.

    Scale: rows are dealt by the prefix of their shuffle key, never by stratum, so a hot stratum is spread evenly. What is
    gathered besides is one count per bucket and stratum. A row moves twice. `df` must give the same rows when read again.
    """
    spark = df.sparkSession
    clash = [c for c in df.columns if c.lower() in ("shard", "slot") or c.lower().startswith("_il_")]
    df = df.drop(*clash)
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    keyed = df.withColumn("_il_h", F.md5(F.concat(F.lit(f"{seed}:"), text_id))).withColumn(
        "_il_s", F.when(F.col(stratum).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(stratum).cast("string"))))
    n = df.count()
    buckets = _bucket_count(df, n)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = 16 ** PREFIX
    keyed = keyed.withColumn("_il_b", F.floor(
        F.conv(F.substring("_il_h", 1, PREFIX), 16, 10).cast("long") * F.lit(buckets) / F.lit(span)).cast("long"))

    # Exact rank in the stratum: rows of the stratum in earlier buckets, plus the rank inside the bucket.
    counts = keyed.groupBy("_il_s", "_il_b").agg(F.count("*").alias("_il_c")).withColumns({
        "_il_o": _before("_il_c", "_il_b", "_il_s"), "_il_n": F.sum("_il_c").over(Window.partitionBy("_il_s"))})
    offsets = counts.groupBy("_il_b").agg(F.map_from_entries(F.collect_list(F.struct(
        "_il_s", F.struct(F.col("_il_o").alias("o"), F.col("_il_n").alias("n"))))).alias("_il_m"))
    order = ["_il_h", id_col, *ties]
    local = Window.partitionBy("_il_b", "_il_s").orderBy(*order)
    ranked = (
        keyed.repartition(parts, "_il_b").withColumn("_il_r", F.row_number().over(local) - 1)
        .join(offsets, "_il_b").withColumn("_il_at", F.col("_il_m")[F.col("_il_s")])
        .withColumn("_il_f", (F.col("_il_at.o") + F.col("_il_r") + F.lit(0.5)) / F.col("_il_at.n")).drop("_il_m", "_il_at", "_il_r")
    )

    # Position in the order by fraction, in the same way.
    placed = ranked.withColumn("_il_b", F.least(F.floor(F.col("_il_f") * buckets), F.lit(buckets - 1)).cast("long"))
    starts = placed.groupBy("_il_b").agg(F.count("*").alias("_il_c")).select(
        "_il_b", _before("_il_c", "_il_b").alias("_il_o"))
    across = Window.partitionBy("_il_b").orderBy("_il_f", "_il_s", *order)
    out = placed.repartition(parts, "_il_b").withColumn("_il_p0", F.row_number().over(across) - 1).join(starts, "_il_b")
    out = out.withColumn("_il_p", F.col("_il_o") + F.col("_il_p0"))
    shard = F.floor(F.col("_il_p") * n_shards / F.lit(max(n, 1))).cast("int")
    first = F.ceil(shard.cast("long") * F.lit(n) / F.lit(n_shards)).cast("long")
    return out.select(*df.columns, shard.alias("shard"), (F.col("_il_p") - first).alias("slot"))
