"""Per-model and master reports, built from one pass over the predictions."""

from pyspark.sql import functions as F

from commentlake.functions.labels import is_tagged
from commentlake.operators import metrics as M, models as ML, quality as Q, ranking as R
from commentlake.session import materialize

MODEL = M.MODEL


def _test_counts(cells):
    """Confusion counts of rows that can be evaluated."""
    return cells.filter(is_tagged("truth") & F.col("pred").isNotNull()).select(MODEL, "truth", "pred", "n")


def model_summary(predictions, cv=None, run_ts=None):
    """One nested row per model: data quality, prediction analysis and performance.

    The predictions are aggregated once into a few rows per model, which are written out; everything else is
    derived from those.
    """
    cells = materialize(Q.prediction_cells(predictions))
    counts = _test_counts(cells)
    quality = Q.data_quality_of(cells)
    dist = Q.prediction_distribution_of(cells).groupBy(MODEL).agg(
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("sentiment_distribution"),
        F.map_from_entries(F.collect_list(F.struct("label", "percent"))).alias("sentiment_percentages"))
    conf = Q.confidence_stats_of(cells)
    summary = M.summary_of(counts)
    classes = M.class_metrics_of(counts).groupBy(MODEL).agg(F.map_from_entries(F.collect_list(F.struct(
        "label", F.struct("precision", "recall", "f1", "support")))).alias("per_class_metrics"))
    matrix = counts.groupBy(MODEL).agg(F.array_sort(F.collect_list(F.struct("truth", "pred", "n"))).alias("confusion_matrix"))

    def packed(df, name):
        return df.select(MODEL, F.struct(*[c for c in df.columns if c != MODEL]).alias(name))
    out = packed(quality, "data_quality").join(dist, MODEL, "left").join(packed(conf, "confidence_stats"), MODEL, "left") \
        .join(packed(summary, "metrics"), MODEL, "left").join(classes, MODEL, "left").join(matrix, MODEL, "left")
    if cv is not None:
        out = out.join(packed(cv, "cross_validation"), MODEL, "left")
    stamp = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    performance = ["metrics", "per_class_metrics", "confusion_matrix"] + (["cross_validation"] if cv is not None else [])
    return out.select(
        MODEL, stamp.alias("run_ts"), F.col("data_quality.total_samples").alias("total_predictions"), "data_quality",
        F.struct("sentiment_distribution", "sentiment_percentages", "confidence_stats").alias("prediction_analysis"),
        F.struct(*performance).alias("performance_metrics"))


def master_report(predictions, models, settings=None, run_ts=None):
    """One nested row over all models: metrics by family, rankings, recommendations and settings."""
    metrics = materialize(M.summary_metrics(M.evaluable(predictions)))
    entry = F.struct(MODEL, *[c for c in metrics.columns if c != MODEL])
    traditional = R.is_traditional()

    def of(cond):
        return F.array_sort(F.collect_list(F.when(cond, entry)))
    base = metrics.agg(
        of(traditional).alias("traditional_models"), of(~traditional).alias("neural_models"),
        F.count("*").alias("total_models_evaluated"))
    ranked = R.rank_models(metrics, models).groupBy("metric").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", MODEL))), lambda x: x[MODEL]).alias("models"))
    rankings = ranked.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("by_"), "metric"), "models"))).alias("m"))
    advice = R.recommendations(metrics, models)
    order = F.array_position(F.array(*[F.lit(x) for x in (
        "best_overall", "best_traditional", "best_neural", "excellent", "good")]), F.col("kind"))
    texts = advice.agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "recommendation"))),
                                   lambda x: x["recommendation"]).alias("r"))
    stamp = F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")
    config = F.lit(None).cast("string") if settings is None else F.lit(str(settings))
    return base.select(
        stamp.alias("run_ts"),
        F.struct("traditional_models", "neural_models", "total_models_evaluated").alias("performance_summary"),
        rankings.select("m").scalar().alias("model_rankings"), texts.select("r").scalar().alias("recommendations"),
        config.alias("model_configurations"))


def results_summary(metrics, cv, models):
    """Models by test accuracy with cross-validation mean and deviation and macro figures."""
    ranked = R.competition_order(metrics, "accuracy", models)
    return ranked.join(cv, MODEL, "left").select(
        "rank", MODEL, "cv_mean", "cv_std", F.col("accuracy").alias("test_accuracy"), "precision_macro",
        "recall_macro", "f1_macro")


def trained_predictions(comparison, df, key="id", text="text"):
    """Every row of `df` predicted by the models of a comparison in one pass, with the tag of the rows that were held out.

    Rows that trained the models have no tag here, so reports over the result evaluate on held-out rows only.
    """
    rows = comparison.inputs.transform(df.withColumn("text_length", F.length(text)))
    held = comparison.predictions.filter(F.col("is_test") & (F.col(MODEL) == comparison.models[0].name)).select(key, M.TRUTH)
    return ML.predict_all(comparison.models, rows, (key, "text_length")).join(held, key, "left")
