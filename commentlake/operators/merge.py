"""Joins of comments with tags, and of model outputs with each other."""

from pyspark.sql import functions as F

from commentlake.operators.clean import select_available, to_wide
from commentlake.operators.scale import global_position, spread_join


def merge_tags(comments, tags, key="id", hot_share=None):
    """Every comment with its tag if there is one; missing text becomes ''. Repeated tag ids fan out.

    Comments without an id are kept without a tag; they and, with `hot_share`, often repeated ids are spread (`spread_join`).
    """
    left = select_available(comments).withColumn("text", F.coalesce("text", F.lit("")))
    right = tags.select(*[c for c in (key, "manual_sentiment", "is_tagged") if c in tags.columns])
    return spread_join(left, right, key, "left", hot_share)


def ids_only_in_tags(comments, tags, key="id"):
    return _ids(tags, key).join(_ids(comments, key), key, "left_anti")


def ids_only_in_comments(comments, tags, key="id"):
    return _ids(comments, key).join(_ids(tags, key), key, "left_anti")


def _ids(df, key):
    return df.filter(F.col(key).isNotNull()).select(key).distinct()


def merge_model_outputs(a, b, suffixes=("_roberta", "_gb"), hot_share=None):
    """Two models' rows side by side on id, or on text where there is no id; shared columns get suffixes.

    Rows without the key match nothing. Texts pair rows only if each is there once on one side at least; a text repeated on both
    raises, as it names no row.
    """
    on = next((c for c in ("id", "text") if c in a.columns and c in b.columns), None)
    if on is None:
        raise ValueError("the tables share neither id nor text; use merge_by_order")
    if on == "text":
        often = [t.where(F.col(on).isNotNull()).groupBy(on).count().where("count > 1").select(on) for t in (a, b)]
        if not often[0].join(often[1], on, "left_semi").isEmpty():
            raise ValueError("texts are repeated on both sides and pair no rows; use ids or merge_by_order")
    return spread_join(_suffixed(a, b, suffixes[0], (on,)), _suffixed(b, a, suffixes[1], (on,)), on, "inner", hot_share)


def merge_by_order(a, b, order_a, order_b, suffixes=("_roberta", "_gb")):
    """Pair the rows of two tables by their position in a named total order, up to the shorter one.

    The order must name each row: one that repeats raises, since its rows have no position of their own.
    """
    for table, order in ((a, order_a), (b, order_b)):
        if not table.groupBy(*order).count().where("count > 1").isEmpty():
            raise ValueError(f"the order {list(order)} repeats; add columns that tell its rows apart")
    left = global_position(_suffixed(a, b, suffixes[0], ()), [_renamed(c, b, suffixes[0]) for c in order_a])
    right = global_position(_suffixed(b, a, suffixes[1], ()), [_renamed(c, a, suffixes[1]) for c in order_b])
    return left.join(right, "position", "inner")


def _renamed(c, other, suffix):
    return f"{c}{suffix}" if c in other.columns else c


def _suffixed(df, other, suffix, keep):
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c in other.columns and c not in keep})


def export_tagged(df, tags, key="id"):
    """Every row with its tag ('' if none) and a yes/no flag."""
    marks = tags.select(key, F.col("manual_sentiment").alias("_tag"))
    tag = F.coalesce("_tag", F.lit(""))
    return spread_join(df, marks, key).withColumns({
        "manual_sentiment": tag,
        "is_tagged": F.when(tag != "", "yes").otherwise("no"),
    }).drop("_tag")


def extend_analysis(existing, predictions, models, key="id"):
    """An earlier analysis with the columns of further models, matched on the key."""
    wanted = {
        "sentiment": "ml_sentiment", "confidence": "ml_confidence", "model_type": "model_type",
        "algorithm": "algorithm_name", "prob_positive": "ml_prob_positive", "prob_negative": "ml_prob_negative",
        "prob_neutral": "ml_prob_neutral", "test_accuracy": "test_accuracy",
        "avg_confidence": "avg_training_confidence",
    }
    values = {out: c for out, c in wanted.items() if c in predictions.columns}
    wide = to_wide(predictions, models, key, values)
    fresh = [c for c in wide.columns if c != key]
    return existing.drop(*fresh).join(wide, key, "left")
