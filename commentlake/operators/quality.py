"""Distributions, summary statistics and data checks."""

from pyspark.sql import functions as F

from commentlake.functions.labels import is_tagged, known_label, normalize_label
from commentlake.functions.text import tokenize_words
from commentlake.operators.metrics import MODEL, ratio
from commentlake.operators.scale import quantiles_of, value_counts, with_share
from commentlake.schema import LABELS

BANDS = ("high", "medium", "low")


def percent(n, total):
    return ratio(n * 100.0, total)


def label_distribution(df, label="final_sentiment"):
    """Rows and percent per label."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return with_share(counts)


def distribution_3(df, label="ml_sentiment"):
    """The three classes, always present; percent of recognised rows with one decimal."""
    norm = normalize_label(label)
    sums = df.agg(*[F.count_if(norm == x).alias(f"n_{x}") for x in LABELS])
    total = sum((F.col(f"n_{x}") for x in LABELS[1:]), F.col(f"n_{LABELS[0]}"))
    rows = [F.struct(F.lit(x).alias("label"), F.col(f"n_{x}").alias("n"),
                     F.round(percent(F.col(f"n_{x}"), total), 1).alias("percent")) for x in LABELS]
    return sums.select(F.inline(F.array(*rows)))


def confidence_distribution(df, band="confidence"):
    return label_distribution(df, band).withColumnRenamed("label", "confidence")


STATISTICS = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def score_statistics(df, value="combined_sentiment_score", approximate=False):
    """count, mean, std, min, quartiles and max as one row.

    Quartiles are exact by default, taken from counted distinct values; `approximate` trades them for a mergeable
    sketch in the same pass as the other figures.
    """
    if approximate:
        v = F.col(value)
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000)
        return df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                      F.min(v).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"),
                      F.max(v).alias("max"))
    return statistics_of(value_counts(df, value))


def statistics_of(counts):
    """The same figures from a table of counted values."""
    v, c = F.col("_v"), F.when(F.col("_v").isNotNull(), F.col("_c"))
    mean = counts.agg(F.try_divide(F.sum(v * c), F.sum(c)).alias("m")).scalar()
    quarters = quantiles_of(counts, [0.25, 0.5, 0.75])
    spread = F.sum((v - mean) * (v - mean) * c)
    return counts.agg(
        F.coalesce(F.sum(c), F.lit(0)).alias("count"), F.max(mean).alias("mean"),
        F.sqrt(F.try_divide(spread, F.sum(c) - 1)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    ).withColumn("_q", quarters.select(F.struct("*")).scalar()).select("*", "_q.*").select(*STATISTICS)


def analysis_report(df, approximate=False):
    """Label, confidence and score figures of an analysed table as one nested row.

    The analysis runs once: its rows are reduced to counts per score, label and band, or, with `approximate`,
    aggregated directly.
    """
    score = "combined_sentiment_score"
    if approximate:
        stats = score_statistics(df, approximate=True)
        rows, n = df.withColumn("_c", F.lit(1)), F.col("_c")
    else:
        rows = value_counts(df, score, "final_sentiment", "confidence")
        stats, n = statistics_of(rows), F.col("_c")

    def rows_with(c, x):
        return F.sum(F.when(F.col(c) == x, n).otherwise(0)).alias(x)
    counts = rows.agg(F.sum(n).alias("total_replies"), *[rows_with("final_sentiment", x) for x in LABELS],
                      *[rows_with("confidence", x) for x in BANDS])
    total = F.col("total_replies")
    return counts.select(
        total,
        F.struct(*LABELS).alias("sentiment_distribution"),
        F.struct(*BANDS).alias("confidence_distribution"),
        stats.select(F.struct(*stats.columns)).scalar().alias("score_statistics"),
        *[percent(F.col(x), total).alias(f"{x}_percentage") for x in LABELS])


def reply_statistics(df, approximate=False):
    """Rows, distinct users and text lengths."""
    users = F.approx_count_distinct("username") if approximate else F.countDistinct("username")
    return df.agg(
        F.count("*").alias("total_replies"), users.alias("unique_users"),
        F.avg("reply_length").alias("average_length"), F.max("reply_length").alias("longest"),
        F.min("reply_length").alias("shortest"))


def tag_progress(df, label="manual_sentiment"):
    return df.agg(F.count("*").alias("total"), F.count_if(is_tagged(label)).alias("tagged")).select(
        "total", "tagged", (F.col("total") - F.col("tagged")).alias("remaining"),
        percent(F.col("tagged"), F.col("total")).alias("percent"))


def validate_merged(df, key="id"):
    """Data checks as rows (check, item, value); the label list is a table, so its length is not limited."""
    tagged = is_tagged()
    empty = F.coalesce(F.col("text") == "", F.lit(True))
    length = F.length(F.coalesce("text", F.lit("")))
    per_key = df.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(empty).alias("empty"), F.count_if(tagged & empty).alias("tagged_empty"),
        F.sum(length).alias("length"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
    figures = per_key.agg(
        (F.sum("n") - F.count("*")).alias("duplicate_ids"), F.sum("empty").alias("empty_text"),
        F.sum("tagged_empty").alias("tagged_with_empty_text"), (F.sum("length") / F.sum("n")).alias("mean_length"),
        F.min("shortest").alias("min_length"), F.max("longest").alias("max_length"))
    none = F.lit(None).cast("string")
    rows = [F.struct(F.lit(c).alias("check"), none.alias("item"), F.col(c).cast("double").alias("value"))
            for c in figures.columns]
    labels = df.filter(tagged).groupBy("manual_sentiment").agg(F.count("*").cast("double").alias("value"))
    kind = F.when(known_label("manual_sentiment"), "label").otherwise("unusual_label")
    return figures.select(F.inline(F.array(*rows))).unionByName(
        labels.select(kind.alias("check"), F.col("manual_sentiment").alias("item"), "value"))


def merge_summary(df, label="manual_sentiment"):
    return df.agg(F.count("*").alias("total_rows"), F.count_if(is_tagged(label)).alias("with_tags"),
                  F.count_if(~is_tagged(label)).alias("without_tags"))


def prediction_cells(predictions):
    """Per (model, truth, prediction): everything the per-model reports need, in one pass.

    The table has a handful of rows per model. Spread is kept as a sum of squares around the cell mean, which
    adds up over cells without cancellation.
    """
    conf = F.col("ml_confidence")
    has_text = F.coalesce(F.col("text_length") > 0, F.lit(False))
    return predictions.groupBy(MODEL, F.col("manual_sentiment").alias("truth"), F.col("ml_sentiment").alias("pred")).agg(
        F.count("*").alias("n"), F.count_if(has_text).alias("with_text"), F.sum("text_length").alias("text_length"),
        F.count("text_length").alias("text_rows"), F.count(conf).alias("conf_n"), F.avg(conf).alias("conf_mean"),
        F.coalesce(F.var_pop(conf) * F.count(conf), F.lit(0.0)).alias("conf_m2"), F.min(conf).alias("conf_min"),
        F.max(conf).alias("conf_max"), F.count_if(conf > 0.8).alias("conf_high"))


def data_quality_summary(predictions):
    return data_quality_of(prediction_cells(predictions))


def data_quality_of(cells):
    n = F.col("n")
    return cells.groupBy(MODEL).agg(
        F.sum("n").alias("total_samples"), F.sum("with_text").alias("samples_with_text"),
        F.sum(F.when(is_tagged("truth"), n).otherwise(0)).alias("samples_with_manual_tags"),
        F.try_divide(F.sum("text_length"), F.sum("text_rows")).alias("average_text_length"),
        F.sum(F.when(F.col("pred").isNull(), n).otherwise(0)).alias("missing_predictions"))


def prediction_distribution(predictions):
    return prediction_distribution_of(prediction_cells(predictions))


def prediction_distribution_of(cells):
    """Count and percent per model and class, the three classes always present."""
    sums = cells.groupBy(MODEL).agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("pred") == x, F.col("n")).otherwise(0)).alias(f"n_{x}") for x in LABELS])
    rows = [F.struct(F.lit(x).alias("label"), F.col(f"n_{x}").alias("n"),
                     percent(F.col(f"n_{x}"), F.col("total")).alias("percent")) for x in LABELS]
    return sums.select(MODEL, F.inline(F.array(*rows)))


def confidence_stats(predictions):
    return confidence_stats_of(prediction_cells(predictions))


def confidence_stats_of(cells):
    """Mean, sample standard deviation, range and share above 0.8 per model."""
    merged = cells.filter(F.col("conf_n") > 0).groupBy(MODEL).agg(
        F.sum("conf_n").alias("_n"), F.sum(F.col("conf_n") * F.col("conf_mean")).alias("_s"),
        F.collect_list(F.struct("conf_n", "conf_mean", "conf_m2")).alias("_parts"),
        F.min("conf_min").alias("min"), F.max("conf_max").alias("max"), F.sum("conf_high").alias("high_confidence"))
    mean = F.col("_s") / F.col("_n")
    spread = F.aggregate("_parts", F.lit(0.0), lambda acc, c: acc + c["conf_m2"] + c["conf_n"] * (
        c["conf_mean"] - F.col("_s") / F.col("_n")) * (c["conf_mean"] - F.col("_s") / F.col("_n")))
    return merged.select(
        MODEL, mean.alias("mean"), F.sqrt(F.try_divide(spread, F.col("_n") - 1)).alias("std"), "min", "max",
        "high_confidence", percent(F.col("high_confidence"), F.col("_n")).alias("high_confidence_percent"))


def model_agreement(merged, suffixes=("_roberta", "_gb")):
    """Agreeing rows, mean confidences and both label distributions of two models, as one row."""
    sa, sb = suffixes
    def label(s):
        return F.coalesce(f"ml_sentiment{s}", F.lit("unknown"))
    def pct(s, x):
        return percent(F.count_if(F.col(f"ml_sentiment{s}") == x), F.count(f"ml_sentiment{s}"))
    return merged.agg(
        F.count("*").alias("total"), F.count_if(label(sa) == label(sb)).alias("agreeing"),
        percent(F.count_if(label(sa) == label(sb)), F.count("*")).alias("agreement_percent"),
        F.avg(f"ml_confidence{sa}").alias(f"average_confidence{sa}"),
        F.avg(f"ml_confidence{sb}").alias(f"average_confidence{sb}"),
        *[pct(s, x).alias(f"{x}_percent{s}") for s in suffixes for x in LABELS])


def agreement_matrix(df, columns):
    """For every ordered pair of methods, the share of rows with equal labels among rows that have both.

    Methods are columns here, so one aggregation over the rows answers all pairs.
    """
    names = list(columns)
    labels = {m: normalize_label(c) for m, c in columns.items()}
    aggs, pairs = [], [(a, b) for i, a in enumerate(names) for b in names[i:]]
    for i, (a, b) in enumerate(pairs):
        both = labels[a].isNotNull() & labels[b].isNotNull()
        aggs += [F.count_if(labels[a] == labels[b]).alias(f"_e{i}"), F.count_if(both).alias(f"_b{i}")]
    rows = []
    for i, (a, b) in enumerate(pairs):
        share = ratio(F.col(f"_e{i}"), F.col(f"_b{i}"))
        for m1, m2 in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(m1).alias("method1"), F.lit(m2).alias("method2"), share.alias("agreement")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def term_frequency(df, n=50, sentiment="all", text="text", label="ml_sentiment"):
    """The n most frequent words, of one class if asked."""
    if sentiment != "all":
        df = df.filter(normalize_label(label) == sentiment)
    words = df.select(F.explode(tokenize_words(text)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def training_accuracy(df, pred="ml_sentiment", truth="manual_sentiment"):
    """Share of tagged rows where the prediction equals the tag."""
    return df.filter(F.col(truth).isNotNull()).agg(
        F.count("*").alias("tagged"), F.count_if(F.col(pred) == F.col(truth)).alias("correct")).withColumn(
        "accuracy", ratio(F.col("correct"), F.col("tagged")))
