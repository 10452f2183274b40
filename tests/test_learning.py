import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlake.operators import bayes as B, features as FE, models as ML, neighbors as N
from commentlake.plans import reports as RP
from commentlake.plans.queries import all_queries


def brute(points, queries, k, exclude):
    out = {}
    for qid, q in queries:
        d = sorted((round(float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())), 9), i) for i, p, _ in points
                   if not (exclude and i == qid))
        out[qid] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize("exclude", [False, True])
def test_neighbours_match_brute_force(spark, exclude):
    rng = np.random.default_rng(1)
    # A third of the rows are copies of one point, some more lie on a grid with many equal distances.
    spots = [[0.0, 0.0]] * 40 + rng.integers(0, 4, (40, 2)).astype(float).tolist() + rng.normal(size=(40, 2)).tolist()
    points = [(i, p, "ab"[i % 2]) for i, p in enumerate(spots)]
    train = spark.createDataFrame(points, "id long, embedding array<double>, label string")
    asked = train.select("id", "embedding")
    near = N.knn_candidates(asked, train, 5, exclude, pivots=6, block=8)
    got = {}
    for r in near.orderBy("id", F.round("distance", 9), "neighbour").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(points, [(i, p) for i, p, _ in points], 5, exclude)


def test_exact_match_outvotes(spark):
    train = spark.createDataFrame([(1, [0.0], "a"), (2, [0.1], "b"), (3, [0.1], "b")], "id long, embedding array<double>, label string")
    asked = spark.createDataFrame([(10, [0.0]), (11, [0.1]), (12, [0.09])], "id long, embedding array<double>")
    got = {r["id"]: r["label"] for r in N.knn_classify(asked, train, 3).collect()}
    assert got == {10: "a", 11: "b", 12: "b"}


@pytest.fixture(scope="module")
def tagged(spark):
    words = {"positive": "love great nice", "negative": "hate awful wrong", "neutral": "table chair window"}
    rows = [(i, f"{w} filler{i % 3} words", label) for i, (label, w) in enumerate(list(words.items()) * 15)]
    return spark.createDataFrame(rows, "id long, text string, manual_sentiment string")


def test_vectors_equal_long_tfidf(spark, tagged):
    v = FE.TextVectorizer("social").fit(tagged)
    names = F.array(*[F.lit(t) for t in v.terms])
    s = F.unwrap_udt("features")
    vec = v.transform(tagged).select("id", F.inline(F.arrays_zip(
        F.transform(s["indices"], lambda i: F.get(names, i)).alias("term"), s["values"].alias("x"))))
    long = FE.tfidf_sql(tagged, preset="social")
    both = vec.join(long, ["id", "term"], "full")
    assert both.filter("x IS NULL OR tfidf IS NULL OR abs(x - tfidf) > 1e-9").count() == 0


SMALL = {
    "logistic_regression": dict(max_iter=50, one_vs_rest=True),
    "random_forest": dict(trees=5, depth=4, balanced=True),
    "gradient_boosting": dict(trees=2),
    "svm": dict(C=10.0, size=32),
    "naive_bayes": dict(alpha=0.5),
    "neural_network": dict(hidden=(4,), max_iter=20),
    "knn": dict(k=3),
}


def test_models_predict_every_row_once(spark, tagged):
    c = ML.compare_models(tagged, "punct", SMALL | {"broken": {}}, partitions=2)
    assert list(c.errors) == ["broken"] and [m.name for m in c.models] == list(SMALL)
    rows = c.predictions.withColumn("total", F.aggregate(F.map_values("ml_probs"), F.lit(0.0), lambda a, x: a + x)) \
        .withColumn("top", F.array_max(F.map_values("ml_probs"))).collect()
    assert len(rows) == 45 * len(SMALL)
    assert all(abs(r["total"] - 1) < 1e-6 and r["top"] == r["ml_confidence"] for r in rows)
    assert all(r["ml_probs"][r["ml_sentiment"]] == r["ml_confidence"] for r in rows)
    scores = {r["model_name"]: r["test_accuracy"] for r in c.metrics().collect()}
    assert set(scores) == set(SMALL) and scores["naive_bayes"] == 1.0 and scores["logistic_regression"] == 1.0


def test_cross_validation(spark, tagged):
    rows, _, classes = ML.training_rows(tagged, "letters")
    scores = ML.cross_validate(rows, classes, "naive_bayes", metric="f1_weighted").collect()
    assert sorted(r["fold"] for r in scores) == [0, 1, 2, 3, 4] and all(0 <= r["score"] <= 1 for r in scores)


def test_scaling_and_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "a"), (5.0, 5.0, "b")], "x double, c double, manual_sentiment string")
    out = FE.standard_scale(df, ["x", "c"]).orderBy("x").collect()
    assert [round(r["x"], 6) for r in out] == [-1.224745, 0.0, 1.224745] and {r["c"] for r in out} == {0.0}
    assert {(r["manual_sentiment"], r["weight"]) for r in FE.class_weights(df).collect()} == {("a", 0.75), ("b", 1.5)}


def test_registered_models_take_their_presets(spark, monkeypatch):
    seen = {}

    def record(name):
        def train(*args, **params):
            seen[name] = params
            raise ValueError("not trained")
        return train
    monkeypatch.setitem(ML.TRAINERS, "gradient_boosting", record("gradient_boosting"))
    monkeypatch.setitem(ML.TRAINERS, "neural_network", record("neural_network"))
    for query in ("train_gradient_boosting", "train_mlp"):
        with pytest.raises((RuntimeError, ValueError), match="not trained"):
            all_queries()[query](spark, "/root/testdata/sf0.001")
    assert seen == {"gradient_boosting": ML.SETTINGS["social"]["gradient_boosting"],
                    "neural_network": ML.SETTINGS["features"]["neural_network"]}


def test_registered_comparison_reports_a_failed_model(spark, monkeypatch):
    def fails(*args, **params):
        raise ValueError("lost executor")
    quick = {"naive_bayes": ML.TRAINERS["naive_bayes"], "svm": fails}
    monkeypatch.setattr(ML, "TRAINERS", quick)
    monkeypatch.setitem(ML.SETTINGS, "letters", {n: ML.SETTINGS["letters"][n] for n in quick})
    with pytest.raises(RuntimeError, match="lost executor"):
        all_queries()["compare_models"](spark, "/root/testdata/sf0.001")


def test_neighbours_of_clustered_points(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 8)) * 100
    spots = [(middles[i % 30] + rng.normal(size=8)).tolist() for i in range(2000)] + [middles[0].tolist()] * 1000
    points = [(i, p, "ab"[i % 2]) for i, p in enumerate(spots)]
    train = spark.createDataFrame(points, "id long, embedding array<double>, label string")
    work = []
    near = N.knn_candidates(train.select("id", "embedding"), train, 4, True, pivots=54, work=work)
    got = {}
    for r in near.orderBy("id", F.round("distance", 9), "neighbour").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    x = np.array(spots)
    for i in [*range(0, 2000, 97), 2000, 2001, 2999]:
        d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(9)
        assert got[i] == [j for j in np.lexsort((np.arange(3000), d)) if j != i][:4]
    assert len(got) == 3000 and sum(work) < 0.1 * 2001 * 2004


def test_neighbours_meet_where_partitions_are_not_merged(spark):
    points = [(i, [float(i % 37), float(i // 37)], "ab"[i % 2]) for i in range(150)]
    train = spark.createDataFrame(points, "id long, embedding array<double>, label string")
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        near = N.knn_candidates(train.select("id", "embedding"), train, 3, pivots=6, block=40)
        got = {}
        for r in near.orderBy("id", F.round("distance", 9), "neighbour").collect():
            got.setdefault(r["id"], []).append(r["neighbour"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    assert got == brute(points, [(i, p) for i, p, _ in points], 3, False)


def test_second_search_sends_a_query_once_to_a_shelf(spark, monkeypatch):
    rng = np.random.default_rng(4)
    spots = np.concatenate([rng.normal(size=(600, 40)), np.repeat(rng.normal(size=(1, 40)), 100, 0)])  # no clusters: no cell is ruled out
    train = spark.createDataFrame([(i, p.tolist(), "ab"[i % 2]) for i, p in enumerate(spots)], "id long, embedding array<double>, label string")
    sent, rounds, search = [], [], N._search

    def counting(asked, points, pieces, *rest):
        asked = asked.localCheckpoint()
        sent.append(asked.count()), rounds.append(int((np.asarray(pieces) > 0).sum()))
        return search(asked, points, pieces, *rest)
    monkeypatch.setattr(N, "_search", counting)
    monkeypatch.setattr(N, "ROUND_BYTES", 0)
    near = N.knn_candidates(train.select("id", "embedding"), train, 4, True, pivots=60, block=150)
    got = {}
    for r in near.orderBy("id", F.round("distance", 9), "neighbour").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    for i in [*range(0, 600, 41), 600, 699]:
        d = np.sqrt(((spots - spots[i]) ** 2).sum(1)).round(9)
        assert got[i] == [j for j in np.lexsort((np.arange(700), d)) if j != i][:4]
    # 601 distinct vectors over at least five shelves of 60 cells: a row per cell would be some 30,000 rows.
    assert len(got) == 700 and sum(sent) <= 601 * (1 + sum(rounds[1:])) < 601 * 12
    assert len(rounds) > 2 and max(sent) <= 2 * 601 + 150


def test_unfolded_rows_without_a_shuffle(spark, tagged):
    long = FE.tfidf_sql(tagged, preset="social")
    assert "Exchange" not in long._jdf.queryExecution().executedPlan().toString()
    joined = FE.tfidf_sql(tagged, preset="social", max_bytes=1)
    both = long.join(joined.withColumnRenamed("tfidf", "x"), ["id", "term"], "full")
    assert both.filter("x IS NULL OR tfidf IS NULL OR abs(x - tfidf) > 1e-9").count() == 0 and long.count() == joined.count() > 0
    assert FE.tfidf_sql(tagged.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (None, None), (2, "")], "id long, text string")
    rows = FE.tfidf_sql(odd, preset="letters").collect()  # rows of one key are documents of their own
    assert sorted(r["term"] for r in rows) == ["aa", "aa", "bb", "cc"]


def test_feature_pipeline_views(spark):
    rows = [(i, f"word{i % 3} thing{i % 2} thing{i % 2}", float(i), i % 2 == 0, None if i == 4 else -float(i % 4)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, text string, word_count double, has_caps boolean, vader_compound double")
    train, rest = df.filter("id < 9"), df.filter("id >= 9")
    p = FE.FeaturePipeline("features", min_df=1, max_df=1.0).fit(train)
    assert p.columns == ["word_count", "vader_compound", "has_caps"] and p.width == 3 + len(p.vectorizer.terms)

    def of(kind, source):
        return np.array([r[0].toArray() for r in p.view(p.transform(source), kind).orderBy("id").select("features").collect()])
    raw, scaled, positive = of("raw", train), of("scaled", train), of("absolute", train)
    spread = raw.std(0)
    shift = np.where(np.arange(raw.shape[1]) < 3, raw.mean(0), 0)
    assert np.allclose(scaled, (raw - shift) / np.where(spread > 0, spread, 1)) and np.allclose(positive, np.abs(raw))
    assert raw[4, 1] == 0 and abs(p.gamma - 1 / (spread > 0).sum()) < 1e-12
    assert np.allclose(of("scaled", rest), (of("raw", rest) - shift) / np.where(spread > 0, spread, 1))  # learned on the training rows
    stored = p.view(p.transform(train), "scaled").first()["features"]
    assert np.isfinite(stored.toArray()).all()


def plain_bayes(x, y, k, alpha):
    """Multinomial naive Bayes on dense arrays."""
    prior = np.log([(y == c).sum() for c in range(k)]) - np.log(len(y))
    sums = np.array([x[y == c].sum(0) for c in range(k)]) + alpha
    return prior, np.log(sums) - np.log(sums.sum(1, keepdims=True))


def test_naive_bayes_is_exact(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    x = rng.poisson(0.6, (90, 7)).astype(float)
    y, fold = rng.integers(0, 3, 90), np.arange(90) % 5
    x[3] = 0
    rows = spark.createDataFrame([(i, Vectors.sparse(7, [(j, v) for j, v in enumerate(r) if v]) if i % 2 else Vectors.dense(r), float(c), int(f))
                                  for i, (r, c, f) in enumerate(zip(x, y, fold))], ["id", "features", "label", "fold"])
    models = B.fit(rows, 3, 7, 0.5, "fold", 5)
    whole = {r["id"]: r["probabilities"] for r in B.score(rows, models).collect()}
    held = {r["id"]: r["probabilities"] for r in B.score(rows, models, "fold").collect()}

    def plain(train, asked):
        prior, theta = plain_bayes(x[train], y[train], 3, 0.5)
        z = np.exp(prior + x[asked] @ theta.T)
        return z / z.sum()
    for i in range(90):
        assert np.allclose(whole[i], plain(np.arange(90), i)) and np.allclose(held[i], plain(np.flatnonzero(fold != fold[i]), i))
    assert models.count() == 6
    with pytest.raises(ValueError, match="bytes"):
        B.models_of(B.class_sums(rows), 10 ** 8, 3)


def test_folds_of_one_pass_equal_single_fits(spark, tagged):
    rows, _, classes = ML.training_rows(tagged, "letters")
    one = {r["fold"]: r["score"] for r in ML.cross_validate(rows, classes, "naive_bayes", dict(alpha=0.5)).collect()}
    folded = FE.stratified_folds(rows, 5)
    for i in range(5):
        model = ML.train_naive_bayes(folded.filter(F.col("fold") != i), classes, alpha=0.5)
        held = ML.predict_all([model], folded.filter(F.col("fold") == i), ("id", "manual_sentiment"))
        assert abs(held.filter("ml_sentiment = manual_sentiment").count() / held.count() - one[i]) < 1e-12


def test_a_forest_does_not_depend_on_the_input_partitions(spark, tagged):
    rows, _, classes = ML.training_rows(tagged, "letters")

    def probabilities(parts):
        train = ML.laid_out(rows.repartition(parts))
        return {r["id"]: r["p"] for r in ML.train_random_forest(train, classes, trees=4, depth=3).score(rows, "p").collect()}
    assert probabilities(1) == probabilities(8) == probabilities(5)


def test_comparison_on_the_feature_table(spark, tagged):
    quick = {k: v for k, v in SMALL.items() if k in ("logistic_regression", "naive_bayes", "knn")} | {"broken": {}}
    rows = tagged.withColumn("word_count", F.length("text").cast("double"))
    c = ML.compare_models(rows, "features", quick, label="manual_sentiment", folds=3, min_df=1, max_df=1.0)
    assert list(c.errors) == ["broken"]
    m = {r["model_name"]: r for r in c.metrics().collect()}
    assert set(m) == set(quick) - {"broken"}
    for r in m.values():
        assert 0 <= r["cv_mean"] <= 1 and 0 <= r["auc"] <= 1 and 0 < r["average_confidence"] <= 1 and 0 <= r["high_confidence"] <= 1
    assert m["logistic_regression"]["test_accuracy"] == 1.0 and c.predictions.count() == 3 * 45


def test_holdout_names_model_and_time_on_every_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    p = spark.createDataFrame([(1, "m", "positive", 0.9), (1, "other", "neutral", 0.5)],
                              "id long, model_name string, ml_sentiment string, ml_confidence double")
    rows = ML.predict_holdout(df, p, "m", "2025-01-01 00:00:00").orderBy("id").collect()
    assert [(r["ml_prediction"], r["ml_model"], r["ml_timestamp"].year) for r in rows] == [("positive", "m", 2025), (None, "m", 2025)]


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(0, 30_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    unique = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("u", F.col("k") * 2)
    import commentlake.operators.scale as SC
    out = SC.join_by_weight(rows, unique, ["k"], "n")
    assert out.count() == 30_000 and out.filter("u <> 2 * k").isEmpty() and out.columns == ["k", "v", "u"]


def test_random_features_approximate_the_kernel(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5)) * (rng.random((300, 5)) < 0.6)
    rows = spark.createDataFrame([(i, Vectors.dense(r) if i % 2 else Vectors.sparse(5, [(j, v) for j, v in enumerate(r) if v]))
                                  for i, r in enumerate(x)], ["id", "features"])
    mapped = ML.random_fourier_features(rows, 5, 0.3, 4000).orderBy("id").select("rff").collect()
    z = np.array([r[0].toArray() for r in mapped])
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert z.shape == (300, 4000) and np.abs(z @ z.T - exact).max() < 0.1
    assert ML.random_fourier_features(rows.limit(0), 5, 0.3, 8).count() == 0


def test_models_say_whether_they_converged(spark, tagged):
    few = ML.compare_models(tagged, "letters", {"svm": dict(size=16, max_iter=1), "naive_bayes": dict(alpha=1.0)})
    assert not few.errors
    assert {r.model_name: r.converged for r in few.metrics().collect()} == {"svm": False, "naive_bayes": None}
    rows, _, classes = ML.training_rows(tagged, "letters")
    assert ML.train_logistic(rows, classes, max_iter=1000).converged
    assert not ML.train_logistic(rows, classes, max_iter=1, one_vs_rest=True).converged


def test_trained_reports_evaluate_held_out_rows_only(spark, tagged):
    c = ML.compare_models(tagged, "letters", {"naive_bayes": dict(alpha=1.0)})
    asked = tagged.select("id", "text")
    got = RP.trained_predictions(c, asked).collect()
    test = {r.id: r.manual_sentiment for r in c.predictions.collect() if r.is_test}
    assert sorted(r.id for r in got) == sorted(r.id for r in asked.collect())
    assert {r.id: r.manual_sentiment for r in got if r.manual_sentiment is not None} == test
    report = RP.model_summary(RP.trained_predictions(c, asked)).first()
    assert report.performance_metrics.metrics.support == len(test) and report.total_predictions == len(got)


def test_scaling_analyses_the_texts_once(spark):
    plan = all_queries()["standard_scale"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan  # both the figures and the scaled columns come from the written block


def test_training_partitions_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(1000)
    assert ML.laid_out(rows).rdd.getNumPartitions() == 4
    monkeypatch.setattr(ML, "PARTITION_ROWS", 100)
    assert ML.laid_out(rows).rdd.getNumPartitions() == 10 and ML.laid_out(rows, 3).rdd.getNumPartitions() == 3


def test_feature_table_analyses_and_vectorizes_a_row_once(spark, tagged, monkeypatch):
    made, vectorized, transform = spark.sparkContext.accumulator(0), [], FE.TextVectorizer.transform

    def label(text):
        made.add(1)
        return {"lov": "positive", "hat": "negative"}.get(text[:3], "neutral")

    def counted(self, df):
        vectorized.append(df)
        return transform(self, df)
    monkeypatch.setattr(FE.TextVectorizer, "transform", counted)
    analysed = tagged.select("id", "text", F.udf(label)("text").alias("final_sentiment"))
    rows, pipeline, classes = ML.table_rows(analysed, min_df=1, max_df=1.0)
    assert {(r.id, r.target) for r in rows.collect()} == {(r.id, r.manual_sentiment) for r in tagged.collect()}
    assert made.value == 45 and len(vectorized) == 1 and classes == ["negative", "neutral", "positive"]
    alone = FE.FeaturePipeline("features", min_df=1, max_df=1.0).fit(rows.filter("not is_test").drop("tfidf"))
    assert pipeline.means == pytest.approx(alone.means) and pipeline.term_deviations == pytest.approx(alone.term_deviations)


def test_metrics_score_a_row_once(spark, tagged):
    rows, _, classes = ML.training_rows(tagged, "letters")
    model, scored = ML.train_naive_bayes(rows.filter("not is_test"), classes), spark.sparkContext.accumulator(0)

    def seen(p):
        scored.add(1)
        return p
    counted = F.udf(seen, "array<double>").asNondeterministic()
    again = ML.Fitted(model.name, classes, lambda df, out: model.score(df, out).withColumn(out, counted(out)))
    c = ML.Comparison(None, classes, [again], predictions=ML.predict_all([again], rows, ("id", "manual_sentiment", "is_test")))
    assert c.metrics().first()["test_accuracy"] == 1.0 and c.scored().count() == 45 and scored.value == 45


def test_models_train_side_by_side_without_the_texts(spark, tagged, monkeypatch):
    meet = threading.Barrier(2)

    def train(rows, classes, name):
        meet.wait(60)
        if "text" in rows.columns:
            raise ValueError("texts are read in every step")
        return ML.train_naive_bayes(rows, classes, name)
    monkeypatch.setattr(ML, "TRAINERS", {n: lambda r, c, n=n: train(r, c, n) for n in ("one", "two")})
    c = ML.compare_models(tagged, "letters", {"one": {}, "two": {}}, partitions=2)
    assert not c.errors and [m.name for m in c.models] == ["one", "two"] and c.predictions.count() == 90
