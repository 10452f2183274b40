"""Feature engineering for the classifiers: splits, weights, TF-IDF and scaling."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window, functions as F

from commentlake.functions.text import (
    add_bigrams, english_stop_words, preprocess_letters, preprocess_punct, preprocess_social, tokenize_terms)
from commentlake.functions.times import time_features
from commentlake.operators.clean import coerce_numeric
from commentlake.operators.scale import hash_cuts, join_checked, key_hash
from commentlake.session import materialize


def stratified_split(df, test_share=0.2, seed=42, label="manual_sentiment", key="id", stratify=True,
                     min_test=0):
    """Mark about `test_share` of every class as test rows, chosen by the hash of the key.

    A class's cut value is found from hash-prefix counts, so rows are only compared with it: no class is ranked
    in one task, and the split is the same on every run. Copies of one key stay on one side. A class of one or two
    rows has no test row unless `min_test` asks for some; one row at least is left for training. Rows without a label are split
    like a class of their own.
    """
    return _by_hash(df, [test_share], seed, label if stratify else None, key, at_least=min_test) \
        .withColumn("is_test", F.col("_above") == 0).drop("_above")


def stratified_folds(df, k=5, seed=42, label="manual_sentiment", key="id"):
    """A fold number 0..k-1 per row; folds of a class differ by at most one row for distinct keys.

    Rows without a label are dealt like a class of their own.
    """
    return _by_hash(df, [i / k for i in range(1, k)], seed, label, key).withColumnRenamed("_above", "fold")


def _by_hash(df, fractions, seed, label, key, **options):
    """Rows with the number of cut values their key's hash lies above, as `_above`."""
    named = F.concat(F.lit("="), F.col(label).cast("string")) if label else F.lit("all")
    group = F.coalesce(named, F.lit("none"))
    keyed = df.withColumns({"_group": group, "_hash": key_hash(key, seed)})
    cuts = hash_cuts(keyed, "_group", "_hash", fractions, **options)
    wide = cuts.groupBy("_group").pivot("cut", list(range(len(fractions)))).agg(F.first("upper"))
    above = sum((F.coalesce(F.col("_hash") > F.col(f"`{i}`"), F.lit(True)).cast("int") for i in range(1, len(fractions))),
                F.coalesce(F.col("_hash") > F.col("`0`"), F.lit(True)).cast("int"))
    return join_checked(keyed, wide, "_group").withColumn("_above", above).select(*df.columns, "_above")


# Text preparation and TF-IDF limits of each generation of the workflow.
TEXT_PRESETS = {
    "features": dict(prepare="none", ngrams=2, max_features=500, min_df=2, max_df=0.8),
    "letters": dict(prepare="letters", ngrams=1, max_features=5000, min_df=1, max_df=1.0),
    "social": dict(prepare="social", ngrams=2, max_features=5000, min_df=2, max_df=0.95),
    "punct": dict(prepare="punct", ngrams=2, max_features=10_000, min_df=2, max_df=0.95),
}
PREPARE = {"none": lambda c: F.col(c), "letters": preprocess_letters, "social": preprocess_social,
           "punct": preprocess_punct}

# The feature table.
NUMERIC_FEATURES = (
    "reply_length", "emoji_count", "word_count", "char_count", "positive_keywords", "negative_keywords",
    "combined_sentiment_score", "vader_compound", "vader_positive", "vader_negative", "vader_neutral",
    "textblob_polarity", "textblob_subjectivity",
)
BOOLEAN_FEATURES = ("has_text", "is_nested", "has_question", "has_exclamation", "has_caps")
TIME_FEATURES = ("hour", "day_of_week", "is_weekend")

MAX_CLASSES = 1000


def with_terms(df, text="text", preset="punct", stop_words=None, out="terms"):
    """The row's terms (unigrams, and bigrams if the preset has them).

    Unigrams get a column of their own: the bigram expression uses them several times.
    """
    p = TEXT_PRESETS[preset]
    stop = english_stop_words() if stop_words is None else stop_words
    df = df.withColumn(out, tokenize_terms(PREPARE[p["prepare"]](text), stop))
    return df.withColumn(out, add_bigrams(F.col(out))) if p["ngrams"] == 2 else df


def vocabulary(df, terms="terms", preset="punct", **limits):
    """The most frequent terms within the document-frequency limits: (term, df, cf, idf), at most max_features rows.

    One aggregation of the occurrences gives both frequencies, combined on the map side. Ties in the cut go to the smaller term.
    """
    p = TEXT_PRESETS[preset] | limits
    total = df.agg(F.count("*").alias("n")).scalar()
    # In sorted order a term differs from the one before it at its first occurrence in the row.
    ordered = df.select(F.sort_array(terms).alias("_s"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("_s", F.lit(1), F.greatest(F.size("_s") - 1, F.lit(0))))
    each = ordered.select(F.inline(F.arrays_zip(F.col("_s").alias("term"), before.alias("_before")))).filter("term is not null")
    counts = each.groupBy("term").agg(F.count_if(~F.col("term").eqNullSafe(F.col("_before"))).alias("df"), F.count("*").alias("cf"))
    kept = counts.filter((F.col("df") >= p["min_df"]) & (F.col("df") <= F.lit(float(p["max_df"])) * total))
    return kept.orderBy(F.desc("cf"), "term").limit(p["max_features"]).withColumn(
        "idf", F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1)


MAX_VOCABULARY_BYTES = 64 << 20


def tfidf_sql(df, text="text", key="id", preset="features", stop_words=None, max_bytes=MAX_VOCABULARY_BYTES, **limits):
    """Long TF-IDF (key, term, tfidf), each row's weights with unit length; every row is a document of its own.

    The only exchange counts the vocabulary. Each row then counts its own terms against the vocabulary, which every task
    holds (at most max_features terms; their bytes are checked), and unfolds its weights; no row is moved. A vocabulary of more
    than `max_bytes` is joined by term instead, and the weights are put together by row.
    """
    source = df.select(key, text)
    vectorizer = TextVectorizer(preset, text, stop_words, **limits)
    vocab = vectorizer.learn(source)
    if not vocab:
        return source.select(key, F.lit("").alias("term"), F.lit(0.0).alias("tfidf")).limit(0)
    if sum(len(r["term"].encode()) + 16 for r in vocab) > max_bytes:
        return _tfidf_joined(with_terms(source, text, preset, stop_words), key, vocab)
    return unfolded(vectorizer.transform(source), vectorizer.terms, key)


def unfolded(df, terms, key="id", vector="features"):
    """(key, term, tfidf) of the stored entries of a vector column."""
    # The names are one folded literal, not an expression per term; no term holds a line break.
    names, stored = F.split(F.lit("\n".join(terms)), "\n"), F.unwrap_udt(vector)
    return df.select(key, F.inline(F.arrays_zip(
        F.transform(stored["indices"], lambda i: F.get(names, i)).alias("term"), stored["values"].alias("tfidf"))))


def _tfidf_joined(rows, key, vocab):
    """The same with the vocabulary as a table, shuffled by term and by row."""
    numbered = materialize(rows.select(key, "terms").withColumn("_row", F.monotonically_increasing_id()))
    weights = rows.sparkSession.createDataFrame([(r["term"], r["idf"]) for r in vocab], "term string, idf double")
    counts = numbered.select("_row", F.explode("terms").alias("term")).groupBy("_row", "term").agg(F.count("*").alias("tf"))
    weighted = counts.join(weights, "term").select("_row", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("_row")))
    return weighted.withColumn("tfidf", F.col("w") / length).join(numbered.select("_row", key), "_row").select(key, "term", "tfidf")


class TextVectorizer:
    """TF-IDF as a sparse vector column; the fitted vocabulary is bounded by the preset."""

    def __init__(self, preset="punct", text="text", stop_words=None, out="features", **limits):
        self.preset, self.text, self.out = preset, text, out
        self.stop_words = english_stop_words() if stop_words is None else stop_words
        self.limits = limits
        self.model = None

    def fit(self, df):
        if not self.learn(df):
            raise ValueError("no term passes the document-frequency limits")
        return self

    def learn(self, df):
        """The vocabulary as (term, df, cf, idf), at most max_features rows; empty if no term passes the limits."""
        found = vocabulary(self._terms(df.select(self.text)), preset=self.preset, **self.limits)
        rows = sorted(found.collect(), key=lambda r: r["term"].encode())
        if not rows:
            return rows
        self.terms = [r["term"] for r in rows]
        counter = CountVectorizerModel.from_vocabulary(self.terms, "terms", "_counts")
        scale = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_counts",
                                   outputCol="_scaled")
        self.model = PipelineModel([counter, scale, Normalizer(p=2.0, inputCol="_scaled", outputCol=self.out)])
        return rows

    def transform(self, df):
        return self.model.transform(self._terms(df)).drop("terms", "_counts", "_scaled")

    def _terms(self, df):
        return with_terms(df, self.text, self.preset, self.stop_words)


def tfidf_vector(df, preset="punct", **limits):
    return TextVectorizer(preset, **limits).fit(df).transform(df)


def feature_columns(df):
    return [c for c in (*NUMERIC_FEATURES, *BOOLEAN_FEATURES, *TIME_FEATURES) if c in df.columns]


def numeric_block(df):
    """The numeric, boolean and time features as doubles, missing ones as 0."""
    if "timestamp" in df.columns:
        df = time_features(df)
    df = coerce_numeric(df, [c for c in (*NUMERIC_FEATURES, *TIME_FEATURES) if c in df.columns])
    flags = [c for c in BOOLEAN_FEATURES if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags})


def assemble_features(df, tfidf="tfidf", out="features"):
    """Numeric block and TF-IDF as one vector; the TF-IDF part stays sparse."""
    cols = feature_columns(df)
    extra = [tfidf] if tfidf in df.columns else []
    return VectorAssembler(inputCols=[*cols, *extra], outputCol=out).transform(df)


def standard_scale(df, cols, fit_on=None):
    """Zero mean and unit (population) deviation, fitted on `fit_on`; constant columns are only centred."""
    source = df if fit_on is None else fit_on
    stats = source.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])
    fitted = stats.select(F.struct(*cols)).scalar()

    def scaled(c):
        spread = fitted[c]["s"]
        return (F.col(c) - fitted[c]["m"]) / F.when(spread > 0, spread).otherwise(1.0)
    return df.withColumns({c: scaled(c) for c in cols})


def absolute_features(df, cols):
    """Non-negative features, as multinomial naive Bayes needs."""
    return df.withColumns({c: F.abs(F.col(c)) for c in cols})


class FeaturePipeline:
    """The feature table of a trainer: numeric block and TF-IDF, learned on training rows only.

    `transform` keeps both blocks side by side: the numeric columns as they are and a sparse TF-IDF vector. `view` puts them
    into one vector in the form a trainer needs:

    - raw: the values as they are,
    - scaled: every feature over its population deviation; the numeric block is also centred, TF-IDF is not, so it stays
      sparse. Distances and models with an intercept see no difference between centred and shifted columns.
    - absolute: absolute values, as multinomial naive Bayes needs.

    Columns without spread are not divided. Missing numbers are 0. `text` falls back to the column `text` where the table has none
    of that name.
    """

    VIEWS = ("raw", "scaled", "absolute")

    def __init__(self, preset="features", text="cleaned_text", **limits):
        self.preset, self.text, self.limits = preset, text, limits

    def fit(self, df):
        return self.learn(df).measure(self.transform(df))

    def learn(self, df):
        """The columns and the vocabulary, which is all that `transform` needs."""
        df = numeric_block(df)
        self.columns = feature_columns(df)
        text = self.text if self.text in df.columns else "text"
        self.vectorizer = TextVectorizer(self.preset, text, out="tfidf", **self.limits).fit(df)
        return self

    def measure(self, transformed):
        """Means and deviations of transformed training rows, for the views."""
        found = transformed.agg(
            *[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in self.columns],
            Summarizer.metrics("variance", "count").summary(F.col("tfidf")).alias("tfidf")).first()
        self.means = {c: found[c]["m"] or 0.0 for c in self.columns}
        self.deviations = {c: found[c]["s"] or 0.0 for c in self.columns}
        n = found["tfidf"]["count"]
        self.term_deviations = [(v * (n - 1) / n) ** 0.5 for v in found["tfidf"]["variance"].toArray()]
        return self

    @property
    def width(self):
        return len(self.columns) + len(self.vectorizer.terms)

    @property
    def gamma(self):
        """1 / (features * variance of all entries) of the scaled view: one over the number of features with spread."""
        return 1.0 / max(1, sum(s > 0 for s in (*self.deviations.values(), *self.term_deviations)))

    def transform(self, df):
        return self.vectorizer.transform(numeric_block(df))

    def view(self, df, kind="raw", out="features"):
        if kind not in self.VIEWS:
            raise ValueError(f"unknown view: {kind}")
        block = {c: F.col(c) for c in self.columns}
        if kind == "scaled":
            block = {c: (F.col(c) - self.means[c]) / (self.deviations[c] or 1.0) for c in self.columns}
        elif kind == "absolute":
            block = {c: F.abs(F.col(c)) for c in self.columns}
        terms = "tfidf"
        df = df.withColumns({f"_f{i}": x for i, x in enumerate(block.values())})
        if kind == "scaled":
            terms = "_terms"
            df = ElementwiseProduct(scalingVec=Vectors.dense([1.0 / (s or 1.0) for s in self.term_deviations]), inputCol="tfidf",
                                    outputCol=terms).transform(df)
        made = [f"_f{i}" for i in range(len(block))]
        return VectorAssembler(inputCols=[*made, terms], outputCol=out).transform(df).drop(*made, "_terms")


def label_classes(df, label="manual_sentiment"):
    """The class names in alphabetical order; more than MAX_CLASSES is an error, not a cut."""
    rows = df.filter(F.col(label).isNotNull()).select(label).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    return sorted(r[0] for r in rows)


def encode_labels(df, classes, label="manual_sentiment", out="label"):
    """Alphabetical class index as a double; unknown labels are null."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    return df.withColumn(out, F.when(at > 0, (at - 1).cast("double")))


def decode_labels(index, classes):
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


def choose_target(df, out="target"):
    """final_sentiment if the table has it, else vader_sentiment; missing means neutral."""
    source = "final_sentiment" if "final_sentiment" in df.columns else "vader_sentiment"
    return df.withColumn(out, F.coalesce(F.col(source), F.lit("neutral")))


def class_weights(df, label="manual_sentiment", out="weight"):
    """n / (classes * rows of the class) on every row, so that classes weigh the same in total."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    weights = counts.select(label, (totals["n"] / (totals["k"] * F.col("_n"))).alias(out))
    return join_checked(df, weights, label)
