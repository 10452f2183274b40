"""Lexicon scoring and the full per-comment analysis."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from commentlake.functions import sentiment as S
from commentlake.functions.text import (
    NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS, WORD_RUN, clean_input, count_emoji_runs, count_keywords, text_features)
from commentlake.operators.clean import add_length_flags
from commentlake.operators.scale import spread_join
from commentlake.session import materialize

SCORES = ("vader_compound", "vader_positive", "vader_negative", "vader_neutral", "textblob_polarity",
          "textblob_subjectivity")
INLINE_TERMS = 20_000
DICTIONARY_BYTES = 64 << 20
HOT_WORD = 0.001  # words with a larger share of all (row, word) pairs are dealt over several tasks


def keyword_lexicon(spark):
    """The single-word keywords with valence +1 or -1 and subjectivity 1."""
    rows = {(k, 1.0) for k in POSITIVE_KEYWORDS if " " not in k} | {(k, -1.0) for k in NEGATIVE_KEYWORDS}
    values = ", ".join(f"('{k}', {v}D, 1D)" for k, v in sorted(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS lexicon(term, valence, subjectivity)")


def normalize_lexicon(lexicon):
    """One row per term: the means of its valences and subjectivities. Rows without a term or a valence do not count, a
    missing subjectivity is 0."""
    known = lexicon.where("term is not null and valence is not null")
    return known.groupBy("term").agg(
        F.avg("valence").alias("valence"), F.avg(F.coalesce("subjectivity", F.lit(0.0))).alias("subjectivity"))


def _words(text):
    return F.regexp_extract_all(F.lower(clean_input(text)), F.lit(WORD_RUN), F.lit(0))


def _score_columns(total, pos, neg, hits, words, subjectivity, alpha):
    """Scores from per-row sums: compound is the bounded sum, shares count each unmatched word once."""
    unmatched = words - hits
    mass = pos + neg + unmatched
    zero = F.lit(0.0)
    return {
        "vader_compound": total / F.sqrt(total * total + F.lit(float(alpha))),
        "vader_positive": F.coalesce(F.try_divide(pos, mass), zero),
        "vader_negative": F.coalesce(F.try_divide(neg, mass), zero),
        "vader_neutral": F.coalesce(F.try_divide(unmatched.cast("double"), mass), F.lit(1.0)),
        "textblob_polarity": F.coalesce(F.try_divide(total, hits), zero),
        "textblob_subjectivity": F.coalesce(F.try_divide(subjectivity, hits), zero),
    }


def lexicon_score(df, lexicon, text="text", alpha=15, inline_terms=INLINE_TERMS, max_bytes=DICTIONARY_BYTES):
    """Bounded valence sum, class shares, mean polarity and subjectivity per comment.

    A lexicon of at most `inline_terms` rows, which is checked, becomes literals in the projection: no join, no
    shuffle, the text is read once. A larger one is a dictionary that every task holds if it has at most `max_bytes`, and a table
    joined to the words beyond. All see the same normalized lexicon, so its size does not change a score.
    """
    known = lexicon.where("term is not null and valence is not null").select("term", "valence", "subjectivity")
    raw = known.limit(inline_terms + 1).collect()
    if len(raw) > inline_terms:
        return _score_by_dictionary(df, normalize_lexicon(lexicon), text, alpha, max_bytes)
    groups = {}
    for r in raw:
        groups.setdefault(r["term"], []).append((float(r["valence"]), float(r["subjectivity"] or 0.0)))
    by_term = {t: {"valence": sum(v for v, _ in g) / len(g), "subjectivity": sum(x for _, x in g) / len(g)} for t, g in sorted(groups.items())}
    valence = F.create_map(*[F.lit(x) for t, r in by_term.items() for x in (t, float(r["valence"]))])
    subjective = F.create_map(*[F.lit(x) for t, r in by_term.items() for x in (t, float(r["subjectivity"]))])
    terms = list(by_term)
    # The set test is a hash lookup per word; the maps are only searched for the few words that hit.
    found = df.withColumn("_words", _words(text)) \
        .withColumn("_hits", F.filter("_words", lambda w: w.isin(terms))) \
        .withColumns({
            "_vals": F.transform("_hits", lambda w: F.element_at(valence, w)),
            "_subj": F.transform("_hits", lambda w: F.element_at(subjective, w))})
    def total(c, f=lambda v: v):
        return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + f(v))
    scored = found.withColumns({
        "_total": total("_vals"),
        "_pos": total("_vals", lambda v: F.greatest(v, F.lit(0.0))),
        "_neg": total("_vals", lambda v: F.greatest(-v, F.lit(0.0))),
        "_subjectivity": total("_subj")})
    cols = _score_columns(F.col("_total"), F.col("_pos"), F.col("_neg"), F.size("_hits"), F.size("_words"),
                          F.col("_subjectivity"), alpha)
    return scored.withColumns(cols).drop("_words", "_hits", "_vals", "_subj", "_total", "_pos", "_neg",
                                         "_subjectivity")


SUMS = "struct<total:double,pos:double,neg:double,subj:double,hits:int>"


def _score_by_dictionary(df, lexicon, text, alpha, max_bytes):
    """The words of a row are looked up in one narrow stage; no text is moved."""
    lexicon = materialize(lexicon)
    size = lexicon.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    if size > max_bytes:
        return _score_by_join(df, lexicon, text, alpha)
    table = lexicon.orderBy("term").toArrow()
    terms = df.sparkSession.sparkContext.broadcast((
        table["term"].combine_chunks(), table["valence"].to_numpy(), table["subjectivity"].to_numpy()))

    @F.arrow_udf(SUMS)
    def sums(words: pa.Array) -> pa.Array:
        known, valence, subjectivity = terms.value
        if not len(known):
            at, hit = np.zeros(0, int), np.zeros(len(words.flatten()), bool)
        else:
            found = pc.index_in(words.flatten(), value_set=known)
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            at = found.drop_null().to_numpy()
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())[hit]
        n = len(words)

        def of(x):
            return pa.array(np.bincount(row, x, n))
        v = valence[at]
        return pa.StructArray.from_arrays(
            [of(v), of(np.maximum(v, 0)), of(np.maximum(-v, 0)), of(subjectivity[at]), pa.array(np.bincount(row, minlength=n).astype(np.int32))],
            names=["total", "pos", "neg", "subj", "hits"])
    scored = df.withColumn("_words", _words(text)).withColumn("_s", sums("_words"))
    cols = _score_columns(F.col("_s.total"), F.col("_s.pos"), F.col("_s.neg"), F.col("_s.hits"), F.size("_words"),
                          F.col("_s.subj"), alpha)
    return scored.withColumns(cols).drop("_words", "_s")


def _score_by_join(df, lexicon, text, alpha):
    """The words of a row are counted and joined to the lexicon, frequent words over several tasks; the sums come back by the
    row's number."""
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    words = numbered.select("_row", F.explode(_words(text)).alias("term")).groupBy("_row", "term").agg(F.count("*").alias("_c"))
    v, c = F.col("valence"), F.col("_c")
    zero = F.lit(0.0)
    sums = spread_join(materialize(words), lexicon, "term", "inner", HOT_WORD).groupBy("_row").agg(
        F.sum(v * c).alias("_total"), F.sum(F.greatest(v, zero) * c).alias("_pos"), F.sum(F.greatest(-v, zero) * c).alias("_neg"),
        F.sum("_c").alias("_hits"), F.sum(F.col("subjectivity") * c).alias("_subjectivity"))

    def got(name):
        return F.coalesce(F.col(name), F.lit(0))
    cols = _score_columns(got("_total"), got("_pos"), got("_neg"), got("_hits"), F.size(_words(text)), got("_subjectivity"), alpha)
    return numbered.join(sums, "_row", "left").withColumns(cols).select(*df.columns, *SCORES)


def fuse_scores(df, compound="vader_compound", polarity="textblob_polarity"):
    """Labels of both scorers, combined score, final label and confidence band."""
    return df.withColumns({
        "vader_sentiment": S.classify_compound(compound),
        "textblob_sentiment": S.classify_polarity(polarity),
        "combined_sentiment_score": S.combined_score(compound, polarity),
    }).withColumns({
        "final_sentiment": S.final_sentiment(
            "combined_sentiment_score", "positive_keywords", "negative_keywords", "emoji_count"),
        "confidence": S.confidence_band("combined_sentiment_score"),
    })


def analyze_comments(df, lexicon):
    """Text features, lexicon scores and fused sentiment of every comment, in one narrow stage."""
    scored = fuse_scores(lexicon_score(text_features(add_length_flags(df)), lexicon))
    hour = F.hour("timestamp") if "timestamp" in df.columns else F.lit(None).cast("int")
    return scored.withColumns({"is_nested": F.lit(False), "hour": hour})


def reanalyze(df, lexicon):
    """The same fusion written to *_fixed columns beside an earlier analysis."""
    t = F.coalesce("text", F.lit(""))
    base = df.select(*df.columns, F.struct(
        count_keywords(t, POSITIVE_KEYWORDS).alias("pos"), count_keywords(t, NEGATIVE_KEYWORDS).alias("neg"),
        count_emoji_runs(t).alias("emoji")).alias("_k"))
    kept = [c for c in df.columns if c in SCORES]
    hidden = base.withColumnsRenamed({c: f"_old_{c}" for c in kept})
    scored = lexicon_score(hidden, lexicon)
    combined = S.combined_score("vader_compound", "textblob_polarity")
    out = scored.withColumns({
        "vader_compound_fixed": F.col("vader_compound"), "textblob_polarity_fixed": F.col("textblob_polarity"),
        "combined_score_fixed": combined, "positive_keywords_fixed": F.col("_k.pos"),
        "negative_keywords_fixed": F.col("_k.neg"), "emoji_count_fixed": F.col("_k.emoji"),
    }).withColumns({
        "final_sentiment_fixed": S.final_sentiment(
            "combined_score_fixed", "positive_keywords_fixed", "negative_keywords_fixed", "emoji_count_fixed"),
        "confidence_fixed": S.confidence_band("combined_score_fixed"),
    })
    return out.drop("_k", *SCORES).withColumnsRenamed({f"_old_{c}": c for c in kept})


def compare_with_original(df, old="final_sentiment", new="final_sentiment_fixed"):
    """Rows per label before and after, from one pass over the table."""
    sides = F.array(F.struct(F.col(old).alias("label"), F.lit(1).alias("o"), F.lit(0).alias("f")),
                    F.struct(F.col(new).alias("label"), F.lit(0).alias("o"), F.lit(1).alias("f")))
    pairs = df.groupBy(old, new).agg(F.count("*").alias("_n"))
    return pairs.select("_n", F.inline(sides)).filter(F.col("label").isNotNull()).groupBy("label").agg(
        F.sum(F.col("_n") * F.col("o")).alias("original"), F.sum(F.col("_n") * F.col("f")).alias("fixed"))
