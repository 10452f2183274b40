"""Five rules that combine two models' labels and confidences, all in one narrow pass."""

from pyspark.sql import functions as F

from commentlake.functions.text import _col
from commentlake.operators import metrics as M
from commentlake.operators.ranking import competition_order

# Weighted F1 of the two base models, used as their weights.
WEIGHT_A, WEIGHT_B = 0.784, 0.801

# The rules in registration order.
METHODS = ("majority_vote", "weighted_average", "confidence_weighted", "stacked", "adaptive")


def majority_vote(a, b, conf_a=None, conf_b=None):
    a, b = _col(a), _col(b)
    if conf_a is None or conf_b is None:
        return F.when(a == b, b).otherwise(a)
    return F.when(a == b, a).when(_col(conf_a) > _col(conf_b), a).otherwise(b)


def weighted_average(a, b, conf_a, conf_b, weight_a=WEIGHT_A, weight_b=WEIGHT_B):
    """Label and weighted confidence of the model with the larger weighted confidence."""
    wa = _col(conf_a) * F.lit(weight_a / (weight_a + weight_b))
    wb = _col(conf_b) * F.lit(weight_b / (weight_a + weight_b))
    return F.struct(F.when(wa > wb, _col(a)).otherwise(_col(b)).alias("sentiment"),
                    F.when(wa > wb, wa).otherwise(wb).alias("confidence"))


def confidence_weighted(a, b, conf_a, conf_b):
    ahead = _col(conf_a) > _col(conf_b)
    return F.struct(F.when(ahead, _col(a)).otherwise(_col(b)).alias("sentiment"),
                    F.when(ahead, _col(conf_a)).otherwise(_col(conf_b)).alias("confidence"))


def stacked(a, b, conf_a, conf_b, gap=0.3):
    a, b, ca, cb = _col(a), _col(b), _col(conf_a), _col(conf_b)
    return F.when(a == b, a).when((F.abs(ca - cb) > gap) & (ca > cb), a).otherwise(b)


def adaptive(a, b, conf_a, conf_b, weight_a=WEIGHT_A, weight_b=WEIGHT_B):
    """Vote when both are sure, trust B in the middle range, weigh the two when both are unsure."""
    ca, cb = _col(conf_a), _col(conf_b)
    mean = (ca + cb) / 2
    w = weight_b / (weight_a + weight_b)
    unsure = F.when(cb * F.lit(w) > ca * F.lit(1 - w), _col(b)).otherwise(_col(a))
    return F.when(mean > 0.8, majority_vote(a, b, conf_a, conf_b)).when(mean > 0.5, _col(b)).otherwise(unsure)


def truth_column(df, suffixes=("_roberta", "_gb")):
    names = [f"manual_sentiment{s}" for s in suffixes] + ["manual_sentiment"]
    return next((c for c in names if c in df.columns), None)


def run_ensembles(merged, suffixes=("_roberta", "_gb")):
    """All rules as ensemble_{method} columns; the confidence rules need both confidences."""
    sa, sb = suffixes
    a, b, ca, cb = f"ml_sentiment{sa}", f"ml_sentiment{sb}", f"ml_confidence{sa}", f"ml_confidence{sb}"
    if ca not in merged.columns or cb not in merged.columns:
        return merged.withColumn("ensemble_majority_vote", majority_vote(a, b))
    return merged.withColumns({
        "ensemble_majority_vote": majority_vote(a, b, ca, cb),
        "ensemble_weighted_average": weighted_average(a, b, ca, cb)["sentiment"],
        "ensemble_confidence_weighted": confidence_weighted(a, b, ca, cb)["sentiment"],
        "ensemble_stacked": stacked(a, b, ca, cb),
        "ensemble_adaptive": adaptive(a, b, ca, cb),
    })


def method_columns(df, suffixes=("_roberta", "_gb"), base=("roberta_base", "gradient_boosting_base")):
    """Method name to label column: the ensembles, then the two base models."""
    out = {f"{m}": f"ensemble_{m}" for m in METHODS if f"ensemble_{m}" in df.columns}
    out |= {n: f"ml_sentiment{s}" for n, s in zip(base, suffixes) if f"ml_sentiment{s}" in df.columns}
    return out


def ensemble_long(df, columns, truth=None):
    """One row per input row and method; narrow."""
    truth = truth or truth_column(df)
    entries = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(c).alias("ml_sentiment"))
                        for m, c in columns.items()])
    label = F.col(truth) if truth else F.lit(None).cast("string")
    return df.select(label.alias("manual_sentiment"), F.inline(entries))


def evaluate_ensembles(df):
    """Accuracy, macro P/R/F1, weighted F1 and sample count per rule, on rows with a truth label."""
    cols = {m: c for m, c in method_columns(df).items() if c.startswith("ensemble_")}
    return M.summary_metrics(M.evaluable(ensemble_long(df, cols))).select(
        F.col("model_name").alias("method"), "accuracy", "precision_macro", "recall_macro", "f1_macro",
        "f1_weighted", F.col("support").alias("valid_samples"))


def method_comparison(df):
    """Ensembles and base models by weighted F1 on normalised labels; the best one is flagged."""
    cols = method_columns(df)
    scored = M.normalized_metrics(ensemble_long(df, cols))
    ranked = competition_order(scored, "weighted_f1", list(cols), name="model_name")
    return ranked.select(
        F.col("model_name").alias("method"), F.col("model_name").isin(*METHODS).alias("is_ensemble"), "accuracy",
        "weighted_f1", F.col("rows").alias("total_samples"), "rank", (F.col("rank") == 1).alias("is_best"))
