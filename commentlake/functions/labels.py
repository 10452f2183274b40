"""Label predicates and text previews."""

from pyspark.sql import functions as F

from commentlake.functions.text import _col, strip
from commentlake.schema import LABELS


def is_tagged(c="manual_sentiment"):
    """True for a present, non-empty tag; never null."""
    return F.coalesce(_col(c) != "", F.lit(False))


def normalize_label(c):
    """Short forms to full labels; unknown values stay lower-cased, empty ones become null."""
    s = F.lower(strip(c))
    return (
        F.when(s == "", None)
        .when(s.isin("pos", "+", "positive"), "positive")
        .when(s.isin("neg", "-", "negative"), "negative")
        .when(s.isin("neu", "neutral", "0"), "neutral")
        .otherwise(s)
    )


def known_label(c):
    return F.coalesce(_col(c).isin(*LABELS), F.lit(False))


def preview(c, n):
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
