"""Classifiers on feature vectors: training, comparison, cross-validation and prediction.

Training and prediction are `pyspark.ml` jobs. Several fitted models score a table in one pass: each adds its
probability column to the row, and the long form is unfolded from the row at the end.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import classification as MLC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from commentlake.functions import sentiment as S
from commentlake.operators import bayes, metrics as M
from commentlake.operators.clean import tagged_only
from commentlake.operators.features import (
    FeaturePipeline, TextVectorizer, choose_target, class_weights, decode_labels, encode_labels, label_classes,
    stratified_folds, stratified_split)
from commentlake.operators.neighbors import knn_classify
from commentlake.session import materialize

# Model settings of each generation of the workflow, in registration order.
SETTINGS = {
    "features": {
        "logistic_regression": dict(max_iter=1000, balanced=True),
        "random_forest": dict(trees=100, balanced=True),
        "gradient_boosting": dict(trees=100, step=0.1, depth=3),
        "svm": dict(C=1.0, balanced=True),
        "naive_bayes": dict(alpha=1.0),
        "knn": dict(k=5),
        "neural_network": dict(hidden=(100, 50), max_iter=500),
    },
    "letters": {
        "random_forest": dict(trees=100),
        "svm": dict(C=1.0),
        "naive_bayes": dict(alpha=1.0),
        "logistic_regression": dict(max_iter=1000),
    },
    "social": {
        "gradient_boosting": dict(trees=100, step=0.1, depth=3),
        "logistic_regression": dict(max_iter=1000, C=1.0, one_vs_rest=True),
    },
    "punct": {
        "random_forest": dict(trees=200, depth=20, min_leaf=2),
        "gradient_boosting": dict(trees=150, step=0.1, depth=7, subsample=0.8),
        "svm": dict(C=10.0),
        "logistic_regression": dict(max_iter=2000, C=1.0, one_vs_rest=True),
        "naive_bayes": dict(alpha=0.5),
    },
}
SEED = 42
# Stopping tolerances of the linear and neural models and of the support vector machine.
LINEAR_TOL, SVM_TOL = 1e-4, 1e-3
TRAIN_PARTITIONS, PARTITION_ROWS = 4, 10_000
RFF_ROWS = 256
TRAINED_AT_ONCE = 3  # models of a comparison that train side by side, as many as one-against-the-rest machines do


@dataclass
class Fitted:
    """A trained model: `score` appends an array of class probabilities under the given name."""

    name: str
    classes: list
    score: Callable[[DataFrame, str], DataFrame]
    family: str = "traditional"
    converged: bool | None = None  # whether iterative training ended by its tolerance; null where nothing is iterated


def _one_pass(name, classes, model):
    def score(df, out):
        model.setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred")
        scored = model.transform(df)
        return scored.withColumn(out, vector_to_array("_prob")).drop("_prob", "_raw", "_pred")
    return Fitted(name, classes, score)


def _per_class(name, classes, models, probability):
    """One binary model per class; the positive probabilities are scaled to sum to 1."""
    def score(df, out):
        for i, m in enumerate(models):
            m.setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_pred{i}")
            if hasattr(m, "setProbabilityCol"):
                m.setProbabilityCol(f"_prob{i}")
            df = probability(m.transform(df), i)
        p = F.array(*[F.col(f"_p{i}") for i in range(len(models))])
        df = df.withColumn("_sum", F.aggregate(p, F.lit(0.0), lambda a, x: a + x))
        even = F.lit(1.0 / len(models))
        df = df.withColumn(out, F.transform(p, lambda x: F.when(F.col("_sum") > 0, x / F.col("_sum")).otherwise(even)))
        return df.drop("_sum", *[f"_{c}{i}" for c in ("raw", "pred", "prob", "p") for i in range(len(models))])
    return Fitted(name, classes, score)


def _own_probability(df, i):
    return df.withColumn(f"_p{i}", F.get(vector_to_array(f"_prob{i}"), 1))


def _settled(models, max_iter):
    """Whether every one of the models stopped by its tolerance and not by its number of iterations."""
    runs = [m.summary() if callable(m.summary) else m.summary for m in models]
    return all(r.totalIterations < max_iter for r in runs)


def _weighted(train, balanced):
    return (class_weights(train, "label"), {"weightCol": "weight"}) if balanced else (train, {})


def _one_vs_rest(classifier, train, weight):
    return MLC.OneVsRest(classifier=classifier, parallelism=3, **weight).fit(train).models


def train_logistic(train, classes, name="logistic_regression", max_iter=1000, C=1.0, balanced=False,
                   one_vs_rest=False):
    """L2 logistic regression; the penalty is spread over the training rows, 1 / (C n)."""
    train, weight = _weighted(train, balanced)
    base = MLC.LogisticRegression(maxIter=max_iter, regParam=1.0 / (C * max(train.count(), 1)), elasticNetParam=0.0,
                                  standardization=False, tol=LINEAR_TOL, **({} if one_vs_rest else weight))
    if not one_vs_rest:
        model = base.setFamily("multinomial").fit(train)
        return replace(_one_pass(name, classes, model), converged=_settled([model], max_iter))
    models = _one_vs_rest(base, train, weight)
    return replace(_per_class(name, classes, models, _own_probability), converged=_settled(models, max_iter))


def train_random_forest(train, classes, name="random_forest", trees=100, depth=30, min_leaf=1, balanced=False):
    train, weight = _weighted(train, balanced)
    # The rows keep their node in every tree, so a step neither sends the trees to all tasks nor walks each row down them again.
    forest = MLC.RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=SEED,
                                        featureSubsetStrategy="sqrt", cacheNodeIds=True, **weight)
    return _one_pass(name, classes, forest.fit(train))


def train_gradient_boosting(train, classes, name="gradient_boosting", trees=100, step=0.1, depth=3, subsample=1.0):
    """Boosted trees, one ensemble per class since the binary learner takes two labels only."""
    gbt = MLC.GBTClassifier(maxIter=trees, stepSize=step, maxDepth=depth, subsamplingRate=subsample, seed=SEED)
    return _per_class(name, classes, _one_vs_rest(gbt, train, {}), _own_probability)


def train_naive_bayes(train, classes, name="naive_bayes", alpha=1.0):
    """Multinomial naive Bayes by one aggregation; features must not be negative."""
    models = bayes.fit(train, len(classes), feature_width(train), alpha)
    return Fitted(name, classes, lambda df, out: bayes.score(df, models, out=out))


def feature_width(rows):
    """Length of the feature vectors; at least one row is needed."""
    first = rows.select("features").first()
    if first is None:
        raise ValueError("no training rows")
    return first[0].size


def train_mlp(train, classes, name="neural_network", hidden=(100, 50), max_iter=500):
    width = feature_width(train)
    net = MLC.MultilayerPerceptronClassifier(layers=[width, *hidden, len(classes)], maxIter=max_iter, seed=SEED,
                                             tol=LINEAR_TOL)
    model = net.fit(train)
    return replace(_one_pass(name, classes, model), converged=_settled([model], max_iter))


def rbf_gamma(train):
    """1 / (features * variance of all entries), from the column means and the mean squared length."""
    row = train.select(
        Summarizer.mean(F.col("features")).alias("mean"),
        F.avg(F.aggregate(vector_values("features"), F.lit(0.0), lambda a, x: a + x * x)).alias("sq")).first()
    mean = row["mean"].toArray()
    spread = row["sq"] - len(mean) * float(mean.mean()) ** 2
    return 1.0 / spread if spread > 0 else 1.0


def vector_values(c):
    """The stored entries of a vector column, without making it dense."""
    return F.unwrap_udt(F.col(c))["values"]


def random_fourier_features(df, width, gamma, size, seed=SEED, out="rff"):
    """Random cosines whose inner products approximate the RBF kernel (Rahimi and Recht, 2007).

    Only the stored entries of the sparse vectors travel to Python, in Arrow batches.
    """
    stored = F.unwrap_udt(F.col("features"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def cosines(chunks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rng = np.random.default_rng(seed)
        w = rng.normal(scale=np.sqrt(2.0 * gamma), size=(width, size))
        b = rng.uniform(0.0, 2.0 * np.pi, size)
        for idx, val in chunks:
            rows = []
            for lo in range(0, len(val), RFF_ROWS):  # one product per block of rows
                part, at = val.iloc[lo:lo + RFF_ROWS], idx.iloc[lo:lo + RFF_ROWS]
                x = np.zeros((len(part), width))
                for r, (i, v) in enumerate(zip(at, part)):
                    x[r, slice(None) if i is None else np.asarray(i, dtype=int)] = v
                rows.extend(np.sqrt(2.0 / size) * np.cos(x @ w + b))
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, array_to_vector(cosines(stored["indices"], stored["values"])))


def train_svm(train, classes, name="svm", C=1.0, balanced=False, size=256, gamma=None, max_iter=100, curve_iter=50):
    """RBF support vector machine: linear machines per class on random Fourier features.

    `gamma` is taken from the rows if it is not given. Probabilities come from a logistic curve fitted to each machine's margin.
    The model's `converged` says whether all machines and curves ended within `max_iter` and `curve_iter` iterations.
    """
    width = feature_width(train)
    gamma = rbf_gamma(train) if gamma is None else gamma
    train, weight = _weighted(train, balanced)

    def mapped(df):
        return random_fourier_features(df, width, gamma, size)
    fitted = materialize(mapped(train))
    svc = MLC.LinearSVC(featuresCol="rff", regParam=1.0 / (C * max(fitted.count(), 1)), maxIter=max_iter,
                        tol=SVM_TOL)
    models = MLC.OneVsRest(classifier=svc, featuresCol="rff", parallelism=3, **weight).fit(fitted).models

    def margin(df, i):
        return df.withColumn(f"_margin{i}", array_to_vector(F.array(F.get(vector_to_array(f"_raw{i}"), 1))))
    curves, converged = [], _settled(models, max_iter)
    for i, m in enumerate(models):
        m.setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_pred{i}")
        target = margin(m.transform(fitted), i).withColumn("_is", (F.col("label") == i).cast("double"))
        curve = MLC.LogisticRegression(featuresCol=f"_margin{i}", labelCol="_is", maxIter=curve_iter, tol=LINEAR_TOL).fit(target)
        converged = converged and _settled([curve], curve_iter)
        curves.append(curve.setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_c{i}"))

    def calibrated(df, i):
        return _own_probability(curves[i].transform(margin(df, i)), i).drop(f"_margin{i}", f"_r{i}", f"_c{i}")
    per_class = _per_class(name, classes, models, calibrated)
    return Fitted(name, classes, lambda df, out: per_class.score(mapped(df), out).drop("rff"), converged=converged)


def train_knn(train, classes, name="knn", k=5, key="id"):
    """Keeps the training rows; prediction is a distributed neighbour search."""
    table = train.select(F.col(key).alias("id"), vector_to_array("features").alias("embedding"),
                         decode_labels(F.col("label"), classes).alias("label"))

    def score(df, out):
        asked = df.select(F.col(key).alias("id"), vector_to_array("features").alias("embedding"))
        votes = knn_classify(asked, table, k=k, shares=True)
        probs = F.array(*[F.coalesce(F.try_element_at("shares", F.lit(c)), F.lit(0.0)) for c in classes])
        return df.join(votes.select(F.col("id").alias(key), probs.alias(out)), key, "left")
    return Fitted(name, classes, score)


TRAINERS = {
    "logistic_regression": train_logistic, "random_forest": train_random_forest,
    "gradient_boosting": train_gradient_boosting, "svm": train_svm, "naive_bayes": train_naive_bayes,
    "neural_network": train_mlp, "knn": train_knn,
}


def predict_all(models, df, keep=("id",)):
    """Label, confidence and class probabilities of every model for every row, in one pass over the rows."""
    entries = []
    for i, m in enumerate(models):
        df = m.score(df, f"_m{i}")
        p = F.col(f"_m{i}")
        confidence = F.array_max(p)
        entries.append(F.struct(
            F.lit(m.name).alias("model_name"), F.lit(m.family).alias("model_type"),
            decode_labels(F.array_position(p, confidence) - 1, m.classes).alias("ml_sentiment"),
            confidence.alias("ml_confidence"),
            F.map_from_arrays(F.array(*[F.lit(c) for c in m.classes]), p).alias("ml_probs")))
    return df.select(*keep, F.inline(F.array(*entries)))


def predict_holdout(df, predictions, model, run_at=None, key="id"):
    """Every row with the model's name and the time of the run; the prediction where the row was held out, null elsewhere."""
    held = predictions.filter(F.col("model_name") == model).select(
        key, F.col("ml_sentiment").alias("ml_prediction"), "ml_confidence")
    at = F.current_timestamp() if run_at is None else F.lit(run_at).cast("timestamp")
    return df.join(held, key, "left").withColumns({"ml_model": F.lit(model), "ml_timestamp": at})


# The form of the feature table each model is trained on; the others take it raw.
VIEWS = {"logistic_regression": "scaled", "svm": "scaled", "knn": "scaled", "neural_network": "scaled", "naive_bayes": "absolute"}


class TextInput:
    """What models trained on a text's TF-IDF vector are given."""

    columns = ("features",)

    def __init__(self, vectorizer):
        self.vectorizer = vectorizer

    def transform(self, df):
        return self.vectorizer.transform(df)

    def seen_by(self, name, df):
        return df

    def settings(self, name):
        return {}


class TableInput:
    """What models trained on the feature table are given: their own view of it."""

    def __init__(self, pipeline):
        self.pipeline = pipeline

    @property
    def columns(self):
        return (*self.pipeline.columns, "tfidf")

    def transform(self, df):
        return self.pipeline.transform(df)

    def seen_by(self, name, df):
        return self.pipeline.view(df, VIEWS.get(name, "raw"))

    def settings(self, name):
        return {"gamma": self.pipeline.gamma} if name == "svm" else {}

    def through(self, model):
        """The model over rows that hold the table's blocks instead of its view."""
        return Fitted(model.name, model.classes, lambda df, out: model.score(self.seen_by(model.name, df), out).drop("features"),
                      model.family, model.converged)


@dataclass
class Comparison:
    """Fitted models, the errors of those that failed, and the predictions for all tagged rows."""

    inputs: object
    classes: list
    models: list = field(default_factory=list)
    errors: dict = field(default_factory=dict)
    predictions: DataFrame = None
    folds: DataFrame = None
    _scored: DataFrame = None

    def scored(self):
        """The predictions, made once: every reader of the plain ones has all models score all rows again."""
        if self._scored is None:
            self._scored = materialize(self.predictions)
        return self._scored

    def metrics(self):
        """One row per model: summary metrics on test rows, train and test accuracy, ROC AUC on test rows, mean confidence and
        share of confidences above 0.8 over all rows, whether iterative training converged (null where nothing is iterated), and
        mean and deviation of the fold accuracies (null without folds)."""
        from commentlake.operators.ranking import split_accuracy

        predictions = self.scored()
        test = M.evaluable(predictions).filter("is_test")
        sure = predictions.groupBy(M.MODEL).agg(
            F.avg("ml_confidence").alias("average_confidence"),
            M.ratio(F.count_if(F.col("ml_confidence") > HIGH_CONFIDENCE), F.count("*")).alias("high_confidence"))
        out = M.summary_metrics(test).join(split_accuracy(predictions), M.MODEL).join(
            M.auc_ovr_weighted(test), M.MODEL, "left").join(sure, M.MODEL)
        pairs = [F.lit(x) for m in self.models for x in (m.name, m.converged)]
        out = out.withColumn("converged", F.create_map(*pairs)[F.col(M.MODEL)].cast("boolean"))
        if self.folds is None:
            return out.withColumns({c: F.lit(None).cast("double") for c in ("cv_mean", "cv_std")})
        return out.join(M.cv_summary(self.folds).drop("folds"), M.MODEL, "left")


HIGH_CONFIDENCE = 0.8  # fixed value


def training_rows(df, preset="punct", label="manual_sentiment", fit_on="train", stratify=True, **limits):
    """Tagged rows with split mark, label index and features; the vectorizer and the classes."""
    tagged = materialize(stratified_split(tagged_only(df, label), label=label, stratify=stratify))
    classes = label_classes(tagged, label)
    source = tagged if fit_on == "all" else tagged.filter(~F.col("is_test"))
    vectorizer = TextVectorizer(preset, **limits).fit(source)
    return encode_labels(vectorizer.transform(tagged), classes, label), vectorizer, classes


def table_rows(df, label=None, stratify=True, **limits):
    """Analysed comments with split mark, label index and the two blocks of the feature table, which is learned on the training
    rows after the split; the pipeline and the classes. Without `label` the target is the lexicon's label (`choose_target`)."""
    if label is None:
        df, label = choose_target(df, "target"), "target"
    # The split and the fit read their rows several times: neither the analysis nor the terms of a text are made again for it.
    analysed = materialize(df.filter(F.col(label).isNotNull()))
    rows = materialize(stratified_split(analysed, label=label, stratify=stratify))
    classes = label_classes(rows, label)
    pipeline = FeaturePipeline("features", **limits).learn(rows.filter(~F.col("is_test")))
    rows = materialize(pipeline.transform(rows))
    pipeline.measure(rows.filter(~F.col("is_test")))
    return encode_labels(rows, classes, label).withColumn(M.TRUTH, F.col(label)), pipeline, classes


def laid_out(df, partitions=None, key="id"):
    """Training rows dealt to partitions by the hash of their key, in the order of the key, so that models that sample by
    partition do not depend on how the rows arrived or where the job runs. Without `partitions` their number depends on the
    number of rows alone: iterative training starts a task per partition and step, so small tables take TRAIN_PARTITIONS, and
    larger ones one for every PARTITION_ROWS rows, so that what a task reads does not grow with the table."""
    if partitions is None:
        partitions = max(TRAIN_PARTITIONS, -(-df.select(key).count() // PARTITION_ROWS))
    return df.repartition(partitions, F.col(key)).sortWithinPartitions(key)


def compare_models(df, preset="punct", settings=None, fit_on="train", stratify=True, label=None, folds=0, partitions=None,
                   **limits):
    """Train every model of the preset on the tagged training rows; one that fails is recorded and skipped.

    The preset "features" takes analysed comments and trains on the feature table, each model on its own view of it. With
    `folds` each model is also cross-validated on the training rows.
    """
    if preset == "features":
        rows, pipeline, classes = table_rows(df, label, stratify, **limits)
        inputs = TableInput(pipeline)
    else:
        rows, vectorizer, classes = training_rows(df, preset, label or M.TRUTH, fit_on, stratify, **limits)
        inputs = TextInput(vectorizer)
    # Texts stay behind: only what models and metrics read is dealt out and read again in every step.
    rows = materialize(laid_out(rows.select("id", M.TRUTH, "is_test", "label", *inputs.columns), partitions))
    out = Comparison(inputs, classes)
    train = rows.filter(~F.col("is_test"))
    settings = {n: params | inputs.settings(n) for n, params in (settings or SETTINGS[preset]).items()}

    def trained(name):
        try:
            return TRAINERS[name](inputs.seen_by(name, train), classes, **settings[name]), None
        except Exception as e:  # one failing model must not stop the others
            return None, str(e)
    with ThreadPool(TRAINED_AT_ONCE) as pool:
        fitted = pool.map(inheritable_thread_target(rows.sparkSession)(trained), settings, chunksize=1)
    scores = []
    for (name, params), (model, error) in zip(settings.items(), fitted):
        try:
            if folds and model:
                scores.append(materialize(cross_validate(inputs.seen_by(name, train), classes, name, params, folds,
                                                         partitions=partitions)))
        except Exception as e:
            error = str(e)
        if error is not None:
            out.errors[name] = error
        else:
            out.models.append(inputs.through(model) if isinstance(inputs, TableInput) else model)
    if out.models:
        out.predictions = predict_all(out.models, rows, ("id", M.TRUTH, "is_test"))
    for s in scores:
        out.folds = s if out.folds is None else out.folds.unionByName(s)
    return out


def cross_validate(rows, classes, name, params=None, k=5, metric="accuracy", label="manual_sentiment", partitions=None):
    """Score of every stratified fold: trained on the others, measured on it. Columns model_name, fold, score.

    Naive Bayes takes all its models from one pass of sums and scores every row in another; the other models are trained k times.
    """
    folded = materialize(stratified_folds(rows, k, label=label))
    if name == "naive_bayes":
        models = bayes.fit(folded, len(classes), feature_width(folded), fold="fold", k=k, **(params or {}))
        held = predict_all([Fitted(name, classes, lambda df, out: bayes.score(df, models, "fold", out=out))], folded,
                           ("id", label, "fold"))
    else:
        parts = []
        for i in range(k):
            model = TRAINERS[name](laid_out(folded.filter(F.col("fold") != i), partitions), classes, **(params or {}))
            parts.append(predict_all([model], folded.filter(F.col("fold") == i), ("id", label, "fold")))
        held = parts[0]
        for p in parts[1:]:
            held = held.unionByName(p)
    held = held.withColumnRenamed(label, M.TRUTH)
    if metric == "accuracy":
        return M.fold_accuracy(held)
    per_fold = held.withColumn(M.MODEL, F.struct(M.MODEL, "fold"))
    return M.summary_metrics(per_fold).select(f"{M.MODEL}.*", F.col(metric).alias("score"))


def score_with_batch_model(df, load, labels, text="text", batch=32, mapping=None):
    """Label and confidence from a caller's batch model.

    `load()` runs once per task and returns a function from a list of texts to an array of logits, one column per
    label. Whole texts are passed on. Rows travel in Arrow batches and are scored `batch` at a time.
    """
    scores = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def softmax(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in chunks:
            out = []
            for i in range(0, len(texts), batch):
                logits = np.asarray(model(texts.iloc[i:i + batch].fillna("").tolist()), dtype=float)
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                out.extend(e / e.sum(axis=1, keepdims=True))
            yield pd.Series(out)

    p = F.zip_with(F.array(*[F.lit(x) for x in labels]), softmax(F.col(text)),
                   lambda a, b: F.struct(a.alias("label"), b.alias("score"))).cast(scores)
    mapped = df.withColumn("_scores", p).withColumn("_best", S.map_model_labels("_scores", mapping or {}))
    return mapped.withColumns({"ml_sentiment": F.col("_best.sentiment"), "ml_confidence": F.col("_best.confidence")}) \
        .drop("_scores", "_best")
