"""Views of the given tables in the shape of comment, tag and prediction tables."""

from pyspark.sql import functions as F

from commentlake.operators.scale import spread
from commentlake.session import scratch_path

# Fixed value: replies per page of the collecting service.
PAGE_SIZE = 100

MODELS = ("roberta_social", "gradient_boosting")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    """Comments without a timestamp: no join, so a query that needs none reads one table only."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("username"),
                    F.length("text").alias("reply_length"))


def texts(spark, sf_dir):
    """The same, spread over the cores for work that is heavy per character."""
    return spread(documents(spark, sf_dir), "id")


def comments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"))
    return texts(spark, sf_dir).join(e, "id", "left").select("id", "text", "username", "timestamp", "reply_length")


def tags(spark, sf_dir):
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), label.alias("manual_sentiment"), F.lit("yes").alias("is_tagged"))


def tagged_comments(spark, sf_dir):
    """Labelled comments only, as a training table."""
    return spread(documents(spark, sf_dir), "id").join(tags(spark, sf_dir), "id")


def _stand_in(ids, factor, shift):
    b = (F.col("id") * factor + shift) % 1000
    kind = b % 10
    label = F.when(kind < 5, "negative").when(kind < 8, "positive").otherwise("neutral")
    conf = F.lit(0.35) + F.lit(0.65) * b.cast("double") / F.lit(1000.0)
    return ids.select("*", label.alias("ml_sentiment"), conf.alias("ml_confidence"))


def predictions_of(df, model):
    """A deterministic stand-in for a trained model's output over any table with an id."""
    factor, shift = (7919, 13) if model == MODELS[0] else (104729, 7)
    return _stand_in(df, factor, shift)


def pred_a(spark, sf_dir):
    return predictions_of(documents(spark, sf_dir).select("id"), MODELS[0])


def pred_b(spark, sf_dir):
    return predictions_of(documents(spark, sf_dir).select("id"), MODELS[1])


def class_probabilities():
    """The confidence for the predicted class, the rest split 3:1 over the other two."""
    rest = F.lit(1.0) - F.col("ml_confidence")
    big, small = rest * F.lit(0.75), rest * F.lit(0.25)
    s, c = F.col("ml_sentiment"), F.col("ml_confidence")
    return F.create_map(
        F.lit("negative"), F.when(s == "negative", c).otherwise(big),
        F.lit("neutral"), F.when(s == "neutral", c).when(s == "negative", big).otherwise(small),
        F.lit("positive"), F.when(s == "positive", c).otherwise(small))


def predictions(spark, sf_dir):
    """Long predictions of both models with the tag, text length and class probabilities of each comment."""
    base = documents(spark, sf_dir).select("id", F.col("reply_length").alias("text_length")) \
        .join(tags(spark, sf_dir).select("id", "manual_sentiment"), "id", "left")
    sides = []
    for m in MODELS:
        kind = "neural_pretrained" if m == MODELS[0] else "traditional"
        p = predictions_of(base, m)
        sides.append(p.select("id", F.lit(m).alias("model_name"), F.lit(kind).alias("model_type"), "ml_sentiment",
                              "ml_confidence", class_probabilities().alias("ml_probs"), "manual_sentiment",
                              "text_length"))
    return sides[0].unionByName(sides[1])


def merged(spark, sf_dir, text=False):
    """Both models side by side with the tag of each comment."""
    from commentlake.operators.merge import merge_model_outputs

    out = merge_model_outputs(pred_a(spark, sf_dir), pred_b(spark, sf_dir)).join(
        tags(spark, sf_dir).select("id", "manual_sentiment"), "id", "left")
    return out.join(documents(spark, sf_dir).select("id", "text"), "id") if text else out


def write_comments_csv(spark, sf_dir):
    """The comments as CSV in the shared folder."""
    from commentlake.sources.writers import write_table

    path = scratch_path(spark, "comments")
    write_table(comments(spark, sf_dir), path, "csv")
    return path


def write_reply_pages(spark, sf_dir):
    """Landed reply pages of at most PAGE_SIZE replies, as JSON lines."""
    reply = F.struct((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", F.col("role").alias("username"))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / PAGE_SIZE)) \
        .agg(F.collect_list(reply).alias("data"))
    path = scratch_path(spark, "pages")
    pages.select("data").write.json(path)
    return path
