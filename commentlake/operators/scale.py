"""Building blocks that keep ranks, quantiles and small-table joins distributed."""

from pyspark.sql import Window, functions as F

from commentlake.session import materialize

SMALL_ROWS, SMALL_BYTES = 100_000, 32 << 20


def spread(df, key):
    """Use all cores for a small input that arrives in fewer partitions; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def join_checked(big, small, on, how="left", max_rows=SMALL_ROWS, max_bytes=SMALL_BYTES):
    """Join with a table that is expected to be small.

    The small side is written once, its rows and bytes are counted, and only then is it broadcast. Above either bound the
    join is left to Spark, which shuffles both sides.
    """
    small = materialize(small)
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(row_bytes(small)), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        small = F.broadcast(small)
    return big.join(small, on, how)


def row_bytes(df):
    """Bytes of a row as text, which is more than its values take in memory for all but short numbers; 16 a column at least."""
    return F.greatest(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), F.lit(16 * len(df.columns)))


def hot_keys(df, key, share):
    """Keys that hold more than `share` of the rows; at most 1 / share of them. A sketch names the candidates, a count decides."""
    known = df.select(F.col(key).alias("_k")).where("_k is not null")
    named = known.freqItems(["_k"], share).first()[0]
    if not named:
        return []
    total = known.count()
    found = known.where(F.col("_k").isin(list(named))).groupBy("_k").count().where(F.col("count") > share * total)
    return [r["_k"] for r in found.collect()]


def spread_join(left, right, key, how="left", hot_share=None, salts=32):
    """Inner or left equi-join in which neither null keys nor hot keys of the left side meet in one task.

    Null keys match nothing, so they are dealt by row. With `hot_share` the keys that hold more than that share of the left rows
    are dealt over `salts` tasks and their right rows are copied to each; without it adaptive execution splits large partitions.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"not a left or inner join: {how}")
    hot = hot_keys(left, key, hot_share) if hot_share else []
    row = F.xxhash64(F.monotonically_increasing_id())
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salt = F.when(F.col(key).isNull(), row).when(is_hot, F.pmod(row, F.lit(salts))).otherwise(F.lit(0)).cast("long")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    known = right.where(F.col(key).isNotNull())
    dealt = known.withColumn("_salt", F.explode(copies) if hot else F.lit(0).cast("long"))
    if how == "inner":
        left = left.where(F.col(key).isNotNull())
    return left.withColumn("_salt", salt).join(dealt, [key, "_salt"], how).drop("_salt")


HOT_KEYS = 50_000


def join_by_weight(rows, unique, on, weight):
    """Inner join with a table that has one row per key and says how many of `rows` have it (column `weight`, dropped).

    Keys that hold more than a 50,000th of all rows are at most 50,000, so they can be sent to every task; the rows of the others
    meet by shuffle. No task gets the rows of a hot key.
    """
    unique = materialize(unique)
    total = unique.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > total // HOT_KEYS
    often, seldom = unique.where(hot).drop(weight), unique.where(~hot).drop(weight)
    return rows.join(F.broadcast(often), on).unionByName(
        rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom, on))


def with_share(counts, n="n", out="percent"):
    """Percent of the grand total; the total is a scalar subquery, not a join or a global window."""
    total = counts.agg(F.sum(n).alias("total")).scalar()
    return counts.withColumn(out, F.col(n) * F.lit(100.0) / total)


def in_order(df, order, partitions=None):
    """Rows range-partitioned and sorted, with `_part` and `_pos` giving the place of each row.

    The result is checkpointed: range bounds are sampled, so a recomputed partition could otherwise disagree
    with offsets taken from an earlier run.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    seq = F.monotonically_increasing_id()
    return materialize(
        ranged.sortWithinPartitions(*keys)
        .withColumn("_seq", seq)
        .withColumns({"_part": F.shiftright("_seq", 33), "_pos": F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("_seq")
    )


def global_position(df, order, name="position", partitions=None):
    """1-based position of every row in a total order, without sorting the table in one task."""
    placed = in_order(df, order, partitions)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return join_checked(placed, offsets, "_part", "inner").withColumn(
        name, F.col("_offset") + F.col("_pos") + 1).drop("_part", "_pos", "_offset")


def running_before(df, group, order, value, name, partitions=None):
    """Sum of `value` over the earlier rows of the group; rows of a group may span many tasks."""
    placed = in_order(df, [*group, *order], partitions)
    earlier = Window.unboundedPreceding, -1
    local = Window.partitionBy("_part", *group).orderBy("_pos").rowsBetween(*earlier)
    across = Window.partitionBy(*group).orderBy("_part").rowsBetween(*earlier)
    zero = F.lit(0)
    offsets = placed.groupBy("_part", *group).agg(F.sum(value).alias("_n")).select(
        "_part", *group, F.coalesce(F.sum("_n").over(across), zero).alias("_offset"))
    summed = placed.withColumn("_local", F.coalesce(F.sum(value).over(local), zero))
    return join_checked(summed, offsets, ["_part", *group], "inner").withColumn(
        name, F.col("_local") + F.col("_offset")).drop("_part", "_pos", "_local", "_offset")


def value_counts(df, value, *others):
    """Rows per distinct value (and other columns), written out once so that what follows does not redo `df`.

    A value held by many rows costs one row here.
    """
    return materialize(df.groupBy(F.col(value).alias("_v"), *others).agg(F.count("*").alias("_c")))


def quantiles_of(counts, probabilities):
    """Exact quantiles of counted values, with linear interpolation, as one row of q{percent} columns."""
    per_value = counts.filter(F.col("_v").isNotNull()).groupBy("_v").agg(F.sum("_c").alias("_c"))
    placed = running_before(per_value, [], ["_v"], "_c", "_before")
    total = per_value.agg((F.sum("_c") - 1).alias("t")).scalar()
    first, last = F.col("_before"), F.col("_before") + F.col("_c") - 1
    aggs, out = [], []
    for p in probabilities:
        at, name = total * F.lit(float(p)), f"q{round(p * 100)}"

        def value_at(row):
            return F.max(F.when((first <= row) & (row <= last), F.col("_v")))
        aggs += [value_at(F.floor(at)).alias(f"{name}_low"), value_at(F.ceil(at)).alias(f"{name}_high")]
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return placed.agg(*aggs).select(*out)


def key_hash(key, seed):
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def hash_cuts(df, group, hashed, fractions, bucket_hex=3, most=100_000, at_least=0):
    """Per group, the hash values below which the given fractions of its rows lie.

    Rows are counted in hash-prefix buckets, and the buckets that a cut falls into are counted again by longer prefixes until
    they hold at most `most` rows or one hash only, so what is ranked does not grow with the data. Cut i keeps
    round(n * fraction) rows at or below its value, `at_least` rows if the group has more; rows with equal hashes (copies of
    one key) stay on one side.
    """
    keyed = df.select(F.col(group).alias("_g"), F.col(hashed).alias("_h"))

    def counted(rows, digits, *by):
        return rows.groupBy(*by, F.substring("_h", 1, digits).alias("_b")).agg(
            F.count("*").alias("_n"), F.min("_h").alias("_low"), F.max("_h").alias("_high"))

    def before(*by):
        return F.coalesce(F.sum("_n").over(
            Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def holding(placed, target):
        return materialize(placed.filter((F.col("_start") < target) & (target <= F.col("_start") + F.col("_n"))).select(
            "_g", "_b", "cut", (target - F.col("_start")).alias("_offset"), "_n", "_low", "_high"))

    def inside(digits):
        places = wanted.select("_g", "_b", "cut", "_offset")
        return join_checked(keyed.withColumn("_b", F.substring("_h", 1, digits)), places, ["_g", "_b"], "inner")

    cut_list = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(float(f)).alias("fraction"))
                         for i, f in enumerate(fractions)])
    placed = counted(keyed, bucket_hex, "_g").withColumns({
        "_start": before("_g"), "_total": F.sum("_n").over(Window.partitionBy("_g"))}).select("*", F.inline(cut_list))
    target = F.round(F.col("_total") * F.col("fraction")).cast("long")
    wanted = holding(placed, F.greatest(target, F.least(F.lit(at_least), F.col("_total") - 1)))
    digits = bucket_hex
    while digits < 32 and not wanted.filter((F.col("_n") > most) & (F.col("_low") < F.col("_high"))).isEmpty():
        finer = counted(inside(digits), min(32, digits + bucket_hex), "_g", "cut", "_offset")
        wanted = holding(finer.withColumn("_start", before("_g", "cut")), F.col("_offset"))
        digits = min(32, digits + bucket_hex)
    counts = inside(digits).groupBy("_g", "cut", "_offset", "_h").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("_g", "cut").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("_cum", F.sum("_c").over(upto)).filter(F.col("_cum") >= F.col("_offset"))
    return reached.groupBy(F.col("_g").alias(group), "cut").agg(F.min("_h").alias("upper"))
