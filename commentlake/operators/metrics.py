"""Evaluation metrics for any number of models at once.

Everything but AUC is derived from one small table of counts per (model, truth, prediction), so the predictions
are read once however many metrics and models there are.
"""

from pyspark.sql import Window, functions as F

from commentlake.functions.labels import known_label, normalize_label
from commentlake.functions.text import strip
from commentlake.operators.scale import running_before
from commentlake.schema import LABELS

MODEL, TRUTH, PRED = "model_name", "manual_sentiment", "ml_sentiment"


def ratio(a, b):
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def evaluable(predictions):
    """Rows with a prediction and a non-blank truth label."""
    return predictions.filter(F.col(PRED).isNotNull() & (strip(TRUTH) != ""))


def label_counts(predictions):
    """Rows per (model, truth, prediction)."""
    return predictions.groupBy(MODEL, F.col(TRUTH).alias("truth"), F.col(PRED).alias("pred")).agg(
        F.count("*").alias("n"))


def confusion_matrix(predictions, labels=None):
    """Counts for every truth x prediction pair, zeros included.

    Without `labels` the grid is the labels seen in either column of the model; with them other labels are ignored.
    """
    counts = label_counts(predictions)
    if labels is not None:
        wanted = counts.filter(F.col("truth").isin(*labels) & F.col("pred").isin(*labels))
        # One pass: a row per model, then the fixed grid unfolded from it.
        cells = [F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"),
                          F.col(f"_{i}_{j}").alias("n"))
                 for i, t in enumerate(labels) for j, p in enumerate(labels)]
        sums = [F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col("n"))), F.lit(0))
                .alias(f"_{i}_{j}") for i, t in enumerate(labels) for j, p in enumerate(labels)]
        return wanted.groupBy(MODEL).agg(*sums).select(MODEL, F.inline(F.array(*cells)))
    seen = counts.select(MODEL, F.explode(F.array("truth", "pred")).alias("label")).distinct()
    grid = seen.withColumnRenamed("label", "truth").join(seen.withColumnRenamed("label", "pred"), MODEL)
    return grid.join(counts, [MODEL, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(predictions):
    """Precision, recall, F1 and support per model and class; 0 where undefined."""
    return class_metrics_of(label_counts(predictions))


def class_metrics_of(counts):
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 hit.alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")))
    sums = counts.select(MODEL, F.inline(sides)).groupBy(MODEL, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary_metrics(predictions):
    """Accuracy with macro and weighted precision, recall and F1; macro over labels in truth or prediction."""
    return summary_of(label_counts(predictions))


def summary_of(counts):
    per_class = class_metrics_of(counts)
    aggs = [F.sum("support").alias("support"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs.append(F.avg(m).alias(f"{m}_macro"))
        aggs.append(ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted"))
    return per_class.groupBy(MODEL).agg(*aggs)


def normalized_metrics(predictions):
    """Accuracy over rows where both normalised labels exist; weighted F1 over the three known labels only."""
    counts = predictions.groupBy(MODEL, normalize_label(TRUTH).alias("truth"), normalize_label(PRED).alias("pred")) \
        .agg(F.count("*").alias("n"))
    both = F.col("truth").isNotNull() & F.col("pred").isNotNull()
    accuracy = counts.groupBy(MODEL).agg(
        F.sum("n").alias("rows"),
        ratio(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))),
              F.sum(F.when(both, F.col("n")))).alias("accuracy"))
    known = counts.filter(known_label("truth") & known_label("pred"))
    f1 = summary_of(known).select(MODEL, F.col("f1_weighted").alias("weighted_f1"))
    return accuracy.join(f1, MODEL, "left").withColumn("weighted_f1", F.coalesce("weighted_f1", F.lit(0.0)))


def weighted_f1_3(predictions):
    return normalized_metrics(predictions).select(MODEL, "weighted_f1")


def accuracy_normalized(predictions):
    return normalized_metrics(predictions).select(MODEL, "accuracy")


def auc_ovr_weighted(predictions, probs="ml_probs"):
    """Area under the ROC curve: two classes directly, more by one-vs-rest weighted by prevalence.

    Rows are first counted per distinct score; the running count of negatives below a score is then taken over
    range partitions, so one model or class may hold any share of the rows.
    """
    rows = evaluable(predictions).select(MODEL, F.col(TRUTH).alias("truth"), F.col(probs).alias("p"))
    prevalence = rows.groupBy(MODEL, "truth").agg(F.count("*").alias("n"))
    per_model = Window.partitionBy(MODEL)
    classes = prevalence.select(
        MODEL, F.col("truth").alias("class"), "n", F.count("*").over(per_model).alias("k"),
        F.max("truth").over(per_model).alias("last"))
    # With two classes only the second one is scored.
    classes = classes.filter((F.col("k") > 2) | ((F.col("k") == 2) & (F.col("class") == F.col("last")))) \
        .select(MODEL, "class", "n")
    scored = rows.select(MODEL, "truth", F.explode("p").alias("class", "score"))
    is_class = F.col("truth") == F.col("class")
    per_score = scored.groupBy(MODEL, "class", "score").agg(
        F.count_if(is_class).alias("np"), F.count_if(~is_class).alias("nn"))
    placed = running_before(per_score, [MODEL, "class"], ["score"], "nn", "below")
    auc = placed.groupBy(MODEL, "class").agg(
        F.try_divide(F.sum(F.col("np") * (F.col("below") + F.col("nn") / 2)),
                     F.sum("np").cast("double") * F.sum("nn")).alias("auc"))
    return auc.join(classes, [MODEL, "class"]).groupBy(MODEL).agg(
        ratio(F.sum(F.col("auc") * F.col("n")), F.sum("n")).alias("auc"))


def evaluate_pretrained(predictions):
    """Summary metrics on tagged rows for every model with predictions; no AUC."""
    return summary_metrics(evaluable(predictions))


def fold_accuracy(predictions, fold="fold"):
    """Accuracy per model and fold."""
    hit = F.col(TRUTH) == F.col(PRED)
    return evaluable(predictions).groupBy(MODEL, fold).agg(
        ratio(F.count_if(hit), F.count("*")).alias("score"))


def cv_summary(fold_scores):
    """Mean and population standard deviation of the fold scores."""
    return fold_scores.groupBy(MODEL).agg(
        F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"), F.count("*").alias("folds"))


def dashboard_confusion(predictions):
    """Fixed three-label matrix on normalised labels."""
    norm = predictions.withColumns({TRUTH: normalize_label(TRUTH), PRED: normalize_label(PRED)})
    return confusion_matrix(norm, LABELS)
