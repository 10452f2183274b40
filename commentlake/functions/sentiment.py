"""Score fusion and label mapping rules as Column expressions."""

from pyspark.sql import functions as F

from commentlake.functions.text import _col


def _three_way(positive, negative):
    return F.when(positive, "positive").when(negative, "negative").otherwise("neutral")


def classify_compound(c):
    return _three_way(_col(c) >= 0.1, _col(c) <= -0.1)


def classify_polarity(c):
    return _three_way(_col(c) > 0.1, _col(c) < -0.1)


def combined_score(compound, polarity):
    return _col(compound) * F.lit(0.6) + _col(polarity) * F.lit(0.4)


def final_sentiment(score, positive, negative, emojis):
    """Score bands first; borderline neutral rows are settled by keywords, then by emoji."""
    score, positive, negative, emojis = map(_col, (score, positive, negative, emojis))
    borderline = F.abs(score) > 0.02
    return (
        F.when(score > 0.05, "positive")
        .when(score < -0.05, "negative")
        .when(borderline & (positive > negative), "positive")
        .when(borderline & (negative > positive), "negative")
        .when(borderline & (emojis > 0) & (score > 0), "positive")
        .otherwise("neutral")
    )


def confidence_band(score):
    size = F.abs(_col(score))
    return F.when(size > 0.3, "high").when(size > 0.1, "medium").otherwise("low")


def map_model_labels(scores, mapping):
    """Best-scored entry of array<struct<label,score>> mapped to a sentiment; the first wins ties."""
    scores = _col(scores)
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    best = F.try_element_at(F.filter(scores, lambda s: s["score"] == top), F.lit(1))
    label = best["label"]
    mapped = F.lower(label)
    for raw, sentiment in mapping.items():
        mapped = F.when(label == raw, sentiment).otherwise(mapped)
    known = F.when(mapped.isin("positive", "neutral", "negative"), mapped).otherwise("neutral")
    return F.when(F.size(scores) > 0, F.struct(known.alias("sentiment"), best["score"].alias("confidence")))


def map_binary_labels(scores, negative="LABEL_0", positive="LABEL_1", margin=0.15):
    """Two-class scores; closer than the margin means neutral at 0.5, unmatched names give null."""
    scores = _col(scores)
    neg = F.try_element_at(F.filter(scores, lambda s: s["label"] == negative), F.lit(1))["score"]
    pos = F.try_element_at(F.filter(scores, lambda s: s["label"] == positive), F.lit(1))["score"]
    sentiment = (
        F.when(F.abs(pos - neg) < margin, "neutral").when(pos > neg, "positive").when(pos <= neg, "negative")
    )
    confidence = F.when(F.abs(pos - neg) < margin, F.lit(0.5)).otherwise(F.greatest(pos, neg))
    return F.when(pos.isNotNull() & neg.isNotNull(),
                  F.struct(sentiment.alias("sentiment"), confidence.alias("confidence")))
