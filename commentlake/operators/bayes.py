"""Multinomial naive Bayes from sufficient statistics.

One aggregation sums every feature per (fold, class). The model of a fold is the total minus the fold's own sums, so a whole
cross-validation costs one pass for training and one for scoring, and its models are exact.
"""

from pyspark.sql import Window, functions as F

from commentlake.session import materialize

ALL = -1  # the fold number of the model that leaves nothing out
MAX_MODEL_BYTES = 256 << 20


def _entries(vector):
    """Positions and values that a vector column stores; all of them where it is dense."""
    stored = F.unwrap_udt(vector)
    last = F.size(stored["values"]) - 1
    every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(stored["indices"], every), stored["values"]


def class_sums(rows, features="features", label="label", fold=None):
    """(fold, label, term, total): the sum of each stored feature, and as term -1 the number of rows.

    Combined on the map side; the result is bounded by folds x classes x features, whatever the number of rows.
    """
    at, values = _entries(features)
    one = F.struct(F.lit(-1).alias("term"), F.lit(1.0).alias("v"))
    pairs = F.zip_with(at, values, lambda i, v: F.struct(i.alias("term"), v.alias("v")))
    by = F.lit(0) if fold is None else F.col(fold).cast("int")
    each = rows.filter(F.col(label).isNotNull()).select(by.alias("fold"), F.col(label).cast("int").alias("label"),
                                                       F.inline(F.concat(F.array(one), pairs)))
    return each.groupBy("fold", "label", "term").agg(F.sum("v").alias("total"))


def models_of(sums, width, classes, alpha=1.0, folds=()):
    """One row per model: fold, and per class its log prior and its array of log feature probabilities.

    Fold f's model is made from the rows of all other folds; fold -1 from all rows. Features are smoothed by alpha, priors are
    not, so a class without rows has the prior 0.
    """
    size = (len(folds) + 1) * classes * (width + 1) * 8
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"{len(folds) + 1} models of {classes} classes and {width} features take {size} bytes")
    spark = sums.sparkSession
    whole = F.sum("total").over(Window.partitionBy("label", "term"))
    own = sums.withColumn("_all", whole)
    # Every cell of every model, those without rows included.
    grid = spark.range(-1, width).select(
        F.col("id").cast("int").alias("term"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("label"),
        F.lit([ALL, *folds]).alias("_folds")).select("term", "label", F.explode("_folds").alias("fold"))
    totals = own.groupBy("label", "term").agg(F.first("_all").alias("_all"))
    cells = grid.join(F.broadcast(totals), ["label", "term"], "left").join(
        F.broadcast(sums), ["fold", "label", "term"], "left").select(
        "fold", "label", "term", (F.coalesce("_all", F.lit(0.0)) - F.when(F.col("fold") == ALL, 0.0).otherwise(
            F.coalesce("total", F.lit(0.0)))).alias("x"))
    per_class = cells.groupBy("fold", "label").agg(
        F.sum(F.when(F.col("term") < 0, F.col("x"))).alias("rows"), F.sum(F.when(F.col("term") >= 0, F.col("x"))).alias("mass"),
        F.array_sort(F.collect_list(F.when(F.col("term") >= 0, F.struct("term", "x")))).alias("cells"))
    log_mass = F.log(F.coalesce("mass", F.lit(0.0)) + alpha * width)
    by_class = per_class.select("fold", "label", F.col("rows"), F.transform(
        "cells", lambda c: F.log(F.greatest(c["x"], F.lit(0.0)) + alpha) - log_mass).alias("weights"))
    every_row = F.sum("rows").over(Window.partitionBy("fold"))
    log_prior = F.when(F.col("rows") > 0.5, F.log("rows") - F.log(every_row)).otherwise(F.lit(float("-inf")))
    return by_class.withColumn("prior", log_prior).groupBy("fold").agg(
        F.array_sort(F.collect_list(F.struct("label", "prior", "weights"))).alias("model"))


def score(rows, models, fold=None, features="features", out="probabilities"):
    """Adds the class probabilities by the model of the row's fold, or of fold -1.

    The models are one row per fold, bounded by `models_of`, and go to every task; rows are not moved.
    """
    at, values = _entries(features)
    key = F.lit(ALL) if fold is None else F.col(fold).cast("int")
    pairs = F.arrays_zip(at.alias("i"), values.alias("v"))
    joined = rows.withColumn("_fold", key).withColumn("_pairs", pairs).join(
        F.broadcast(models.withColumnRenamed("fold", "_fold").withColumnRenamed("model", "_model")), "_fold", "left")
    logs = F.transform("_model", lambda m: F.aggregate(
        "_pairs", m["prior"], lambda acc, p: acc + p["v"] * F.get(m["weights"], p["i"])))
    top = joined.withColumn("_logs", logs).withColumn("_e", F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs"))))
    total = F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x)
    return top.withColumn("_total", total).withColumn(out, F.transform("_e", lambda x: x / F.col("_total"))).drop(
        "_fold", "_pairs", "_model", "_logs", "_e", "_total")


def fit(rows, classes, width, alpha=1.0, fold=None, k=0):
    """The models of `models_of`, written once; `fold` and `k` name the fold column and the number of folds."""
    return materialize(models_of(class_sums(rows, fold=fold), width, classes, alpha, tuple(range(k))))
