"""Connected components of a link table by alternating stars (large-star, small-star), all in DataFrames."""

from pyspark.sql import functions as F

from commentlake.llm.staging import staged

MAX_ROUNDS = 60


def _with_low(pairs):
    """Adds to each (u, v) the least of u and all its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(links, a="a", b="b"):
    """(id, component_id) for every id in `links`; component_id is the least id that can be reached.

    Null ends link nothing. Each round is two small shuffles of the links and a written table; the number of rounds grows with
    the logarithm of the longest chain. Minima are taken by partial aggregation, so an id with many links is no hot task;
    the joins that follow are split by adaptive execution where they are skewed.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null") \
        .where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    def state(rows):
        return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    edges = staged(edges)
    before = state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.where("u <> v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_low(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = _with_low(large.where("u > v"))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small.unionByName(edges.where("u = v")))
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    ids = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
    roots = edges.select(F.col("v").alias("id")).distinct().join(ids, "id", "left_anti")
    return ids.unionByName(roots.select("id", F.col("id").alias("component_id")))
