"""Projections, filters and coercions on comment and prediction tables."""

from pyspark.sql import functions as F

from commentlake.functions.labels import is_tagged, normalize_label
from commentlake.functions.text import _col, clean_input
from commentlake.operators.scale import join_checked

# Defaults for missing entries of an analysed table.
DEFAULTS = {
    "text": "", "cleaned_text": "", "emojis": "", "emoji_count": 0, "word_count": 0, "char_count": 0,
    "positive_keywords": 0, "negative_keywords": 0, "combined_sentiment_score": 0.0,
}

# Column choices of the tag merge and of the per-model outputs.
MERGE_COLUMNS = ("id", "text", "username", "timestamp", "permalink", "reply_length")
MERGE_OPTIONAL = ("media_type", "media_url", "has_text", "is_nested")
OUTPUT_COLUMNS = (
    "id", "text", "username", "timestamp", "permalink", "media_type", "media_url", "reply_length", "has_text",
    "is_nested", "manual_sentiment", "is_tagged",
)

# Columns that end in "_sentiment" without being a model's prediction.
NOT_MODELS = ("manual", "final", "vader", "textblob", "ml", "tagged")


def fill_defaults(df):
    return df.na.fill({c: v for c, v in DEFAULTS.items() if c in df.columns})


def coerce_booleans(df, cols):
    def as_bool(c):
        return F.coalesce(F.lower(F.col(c).cast("string")).isin("true", "1", "yes"), F.lit(False))
    return df.withColumns({c: as_bool(c) for c in cols if c in df.columns})


def coerce_numeric(df, cols):
    """Unparsable or missing entries become 0."""
    def as_double(c):
        return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
    return df.withColumns({c: as_double(c) for c in cols if c in df.columns})


def tagged_only(df, label="manual_sentiment"):
    return df.filter(is_tagged(label))


def untagged_only(df, label="manual_sentiment"):
    return df.filter(~is_tagged(label))


def add_length_flags(df, text="text"):
    return df.withColumns({
        "reply_length": F.length(F.coalesce(F.col(text), F.lit(""))),
        "has_text": clean_input(text) != "",
    })


def select_available(df, base=MERGE_COLUMNS, optional=MERGE_OPTIONAL):
    return df.select(*[c for c in (*base, *optional) if c in df.columns])


def training_gate(df, minimum=10, warn=20, fine_tune=50, label="manual_sentiment"):
    """One status row: enough tags to train, to train without a warning, to fine-tune."""
    n = F.count_if(is_tagged(label))
    return df.agg(n.alias("tagged_rows")).select(
        "tagged_rows",
        F.when(F.col("tagged_rows") < minimum, "stop").when(F.col("tagged_rows") < warn, "warn")
        .when(F.col("tagged_rows") < fine_tune, "train").otherwise("fine_tune").alias("status"))


def model_names(df):
    """Models of a wide table, found by their prediction columns."""
    names = [c[: -len("_sentiment")] for c in df.columns if c.endswith("_sentiment")]
    return [n for n in names if n not in NOT_MODELS]


def to_long(df, models=None, keep=("id",)):
    """One row per input row and model; narrow."""
    entries = []
    for m in models or model_names(df):
        def pick(suffix, kind, name, m=m):
            col = F.col(f"{m}_{suffix}") if f"{m}_{suffix}" in df.columns else F.lit(None)
            return col.cast(kind).alias(name)
        entries.append(F.struct(
            F.lit(m).alias("model_name"), pick("model_type", "string", "model_type"),
            pick("sentiment", "string", "ml_sentiment"), pick("confidence", "double", "ml_confidence")))
    return df.select(*keep, F.inline(F.array(*entries)))


def to_wide(predictions, models, key="id", values=None):
    """One row per key with {model}_{value} columns; model names are given, so no extra pass finds them."""
    values = values or {"sentiment": "ml_sentiment", "confidence": "ml_confidence"}
    aggs = [F.first(c, ignorenulls=True).alias(out) for out, c in values.items()]
    wide = predictions.groupBy(key).pivot("model_name", list(models)).agg(*aggs)
    if len(aggs) == 1:
        only = next(iter(values))
        wide = wide.withColumnsRenamed({m: f"{m}_{only}" for m in models})
    return wide


def attach_metadata(predictions, metrics, run_ts=None):
    """Metrics, family and run time of the model on each of its rows."""
    family = F.when(F.col("model_name").contains("gradient"), "ensemble").otherwise("linear")
    out = join_checked(predictions, metrics, "model_name").withColumn("model_family", family)
    return out if run_ts is None else out.withColumn("run_ts", F.lit(run_ts).cast("timestamp"))


def mark_mismatch(predictions, pred="ml_sentiment", truth="manual_sentiment"):
    """True where both labels exist and differ."""
    p, t = normalize_label(pred), normalize_label(truth)
    return predictions.withColumn("mismatch", F.coalesce(p != t, F.lit(False)))


def algorithm_names(predictions):
    return predictions.select(
        F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in _name_columns(predictions)]).alias("algorithm")
    ).filter(F.col("algorithm").isNotNull()).distinct()


def filter_model(predictions, name):
    """Rows of a model by any of its name columns; an empty name keeps everything."""
    if not name:
        return predictions
    match = F.lit(False)
    for c in _name_columns(predictions):
        match = match | F.coalesce(F.col(c) == name, F.lit(False))
    return predictions.filter(match)


def _name_columns(df):
    return [c for c in ("model_type", "algorithm_name", "model_name") if c in df.columns]


def stack_predictions(*tables):
    """Several models' outputs as one table; columns a table lacks are null."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def nullify_tokens(df, tokens, cols):
    return df.withColumns({c: F.when(~_col(c).isin(*tokens), F.col(c)) for c in cols})
