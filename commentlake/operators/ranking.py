"""Rankings of models, and ordered or per-class samples of rows."""

from pyspark.sql import Window, functions as F

from commentlake.functions.labels import is_tagged, normalize_label, preview
from commentlake.operators.metrics import MODEL, evaluable, ratio

# Models that count as traditional in reports; all others are neural.
TRADITIONAL = ("random_forest", "gradient_boosting", "svm", "logistic_regression", "naive_bayes")


def registration_order(models, name=MODEL):
    return F.array_position(F.array(*[F.lit(m) for m in models]), F.col(name))


def competition_order(metrics, by, models, name=MODEL):
    """Rank by a metric, best first; a missing metric counts as 0 and ties keep registration order.

    A metrics table has one row per model, so the single window partition is as small as the model list.
    """
    best = Window.orderBy(F.coalesce(F.col(by), F.lit(0.0)).desc(), registration_order(models, name), name)
    return metrics.withColumn("rank", F.row_number().over(best))


def rank_models(metrics, models, by=("f1_weighted", "accuracy", "f1_macro")):
    """One ranking per metric, as rows (metric, rank, model_name, value)."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0.0)).alias("value"))
                        for m in by])
    best = Window.partitionBy("metric").orderBy(F.desc("value"), "_order", MODEL)
    return metrics.select(MODEL, registration_order(models).alias("_order"), F.inline(entries)) \
        .withColumn("rank", F.row_number().over(best)).drop("_order")


def pick_winner(metrics, models, by="accuracy"):
    """The best model; the first registered one on ties."""
    return metrics.orderBy(F.coalesce(F.col(by), F.lit(0.0)).desc(), registration_order(models), MODEL) \
        .limit(1).select(MODEL, by)


def winner_columns(predictions, winner):
    """The winner's label, confidence and class probabilities in the generic columns.

    The winner's name reaches the scan of the predictions as a filter; a class it lacks is null.
    """
    name = winner.select(MODEL).scalar()
    chosen = predictions.filter(F.col(MODEL) == name)
    prob = {f"ml_prob_{c}": F.try_element_at("ml_probs", F.lit(c)) for c in ("positive", "negative", "neutral")}
    return chosen.select("id", "ml_sentiment", "ml_confidence", F.col(MODEL).alias("model_type"),
                         *[v.alias(k) for k, v in prob.items()])


def split_accuracy(predictions, is_test="is_test"):
    """Accuracy per model on the training and on the test rows."""
    hit = F.col("manual_sentiment") == F.col("ml_sentiment")
    test = F.col(is_test)
    return evaluable(predictions).groupBy(MODEL).agg(
        ratio(F.count_if(hit & ~test), F.count_if(~test)).alias("train_accuracy"),
        ratio(F.count_if(hit & test), F.count_if(test)).alias("test_accuracy"))


def model_gap(metrics, a, b):
    """Difference of two models' test accuracies with its size band, and an overfit flag for each."""
    def of(model, col):
        return F.max(F.when(F.col(MODEL) == model, F.col(col)))
    gap = F.abs(F.col("test_a") - F.col("test_b"))
    return metrics.agg(
        of(a, "test_accuracy").alias("test_a"), of(b, "test_accuracy").alias("test_b"),
        (of(a, "train_accuracy") - of(a, "test_accuracy") > 0.1).alias("overfit_a"),
        (of(b, "train_accuracy") - of(b, "test_accuracy") > 0.1).alias("overfit_b"),
    ).select("test_a", "test_b", gap.alias("gap"),
             F.when(gap < 0.02, "similar").when(gap < 0.05, "small").otherwise("significant").alias("band"),
             "overfit_a", "overfit_b")


def is_traditional(name=MODEL):
    return F.col(name).isin(*TRADITIONAL)


def recommendations(metrics, models):
    """Best model overall and per family, and the models of each quality tier, as one row per statement."""
    f1 = F.coalesce(F.col("f1_weighted"), F.lit(0.0))
    ranked = competition_order(metrics, "f1_weighted", models).select(
        "rank", MODEL, f1.alias("f1"), is_traditional().alias("traditional"))
    in_family = Window.partitionBy("traditional").orderBy("rank")
    ranked = ranked.withColumn("family_rank", F.row_number().over(in_family))
    first = F.col("family_rank") == 1
    kinds = F.array_compact(F.array(
        F.when(F.col("rank") == 1, "best_overall"),
        F.when(first & F.col("traditional"), "best_traditional"),
        F.when(first & ~F.col("traditional"), "best_neural"),
        F.when(F.col("f1") > 0.85, "excellent"),
        F.when((F.col("f1") > 0.75) & (F.col("f1") <= 0.85), "good")))
    per_kind = ranked.select(F.explode(kinds).alias("kind"), MODEL, "f1", registration_order(models).alias("_o")) \
        .groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("_o", MODEL))).alias("m"), F.max("f1").alias("f1"))
    names = F.array_join(F.transform("m", lambda x: x[MODEL]), ", ")
    # The wording of the report's sentences.
    score = F.format_string(" (F1: %.3f)", "f1")
    text = (
        F.when(F.col("kind") == "best_overall", F.concat(F.lit("Best overall model: "), names, score))
        .when(F.col("kind") == "best_traditional", F.concat(F.lit("Best traditional model: "), names, score))
        .when(F.col("kind") == "best_neural", F.concat(F.lit("Best neural model: "), names, score))
        .when(F.col("kind") == "excellent",
              F.concat(F.lit("Models with excellent performance (F1>0.85): "), names))
        .otherwise(F.concat(F.lit("Models with good performance (0.75<F1<=0.85): "), names)))
    return per_kind.select("kind", names.alias("models"), text.alias("recommendation"))


def sample_per_class(df, n, label="manual_sentiment", key="id"):
    """The first n rows of each label; Spark keeps at most n rows per label and task before the shuffle."""
    first = Window.partitionBy(label).orderBy(key)
    return df.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)


def disagreements(df, cols, n=20, key="id", text="text", width=150):
    """First n rows where the given label columns are all present and not all equal."""
    labels = [normalize_label(c) for c in cols]
    differ = F.lit(False)
    for x in labels[1:]:
        differ = differ | (labels[0] != x)
    present = F.lit(True)
    for x in labels:
        present = present & x.isNotNull()
    return df.filter(present & differ).orderBy(key).limit(n).withColumn("preview", preview(text, width))


def sample_comments(df, n=50, key="id"):
    """First n rows with their predicted and true label and whether they clash."""
    from commentlake.operators.clean import mark_mismatch

    return mark_mismatch(df.orderBy(key).limit(n))


def untagged_batch(df, tags, after, n, key="id"):
    """The next n untagged rows after a position, wrapping around to the first untagged ones."""
    done = tags.filter(is_tagged()).select(key)
    return df.join(done, key, "left_anti").orderBy(F.col(key) <= after, key).limit(n)
