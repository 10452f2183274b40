"""Registered queries: each operator over the whole given tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlake.functions import labels as L, sentiment as S, text as X, times as D
from commentlake.operators import (
    clean as C, ensemble as E, features as FE, lexicon as LX, merge as J, metrics as M, models as ML, neighbors as N,
    quality as Q, ranking as R)
from commentlake.operators.features import stratified_folds, stratified_split
from commentlake.operators.scale import join_checked
from commentlake.plans import fixtures as FX, reports as RP, scorer
from commentlake.session import materialize, scratch_path
from commentlake.sources import comments as SC, pages as SP, writers as K

MODELS = list(FX.MODELS)


def rounded(df, digits=6):
    """Doubles rounded, so that results do not depend on the order of summation."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def _text(name, expr, strip=True):
    def run(spark, sf):
        t = X.clean_input("text") if strip else F.col("text")
        return FX.texts(spark, sf).select("id", expr(t).alias(name))
    return run


def _tagged(spark, sf):
    """All comments with their tags."""
    return J.merge_tags(FX.documents(spark, sf), FX.tags(spark, sf))


def _analyzed(spark, sf, source=None):
    return LX.analyze_comments((source or FX.comments)(spark, sf), LX.keyword_lexicon(spark))


def _lexicon_joined(spark, sf, max_bytes=0):
    """The scores of a lexicon that is too large for literals, with every term twice (mean valence as in the keyword lexicon)."""
    lexicon = LX.keyword_lexicon(spark)
    halves = [lexicon.withColumn("valence", F.col("valence") * x) for x in (0.5, 1.5)]
    scored = LX.lexicon_score(FX.texts(spark, sf), halves[0].unionByName(halves[1]), inline_terms=0, max_bytes=max_bytes)
    return rounded(scored.select("id", *LX.SCORES))


def _from_analysis(*cols):
    return lambda spark, sf: rounded(_analyzed(spark, sf, FX.texts).select("id", *cols))


def _eval(spark, sf):
    return M.evaluable(FX.predictions(spark, sf))


def _summary(spark, sf):
    return M.summary_metrics(_eval(spark, sf))


def _ensembled(spark, sf, text=False):
    return E.run_ensembles(FX.merged(spark, sf, text))


def _split_predictions(spark, sf):
    split = stratified_split(FX.tags(spark, sf)).select("id", "is_test")
    return FX.predictions(spark, sf).join(split, "id")


def _fold_scores(spark, sf):
    folds = stratified_folds(FX.tags(spark, sf)).select("id", "fold")
    return M.fold_accuracy(FX.predictions(spark, sf).join(folds, "id"))


def _label_array(spark, sf):
    entry = [F.struct(F.lit(f"LABEL_{i}").alias("label"), F.col("ml_probs")[c].alias("score"))
             for i, c in enumerate(("negative", "neutral", "positive"))]
    return C.filter_model(FX.predictions(spark, sf), MODELS[0]).select("id", F.array(*entry).alias("scores"))


def _read_comments(spark, sf):
    return SC.read_comments(spark, FX.write_comments_csv(spark, sf))


def _flatten(spark, sf):
    return SP.flatten_reply_pages(SP.read_reply_pages(spark, FX.write_reply_pages(spark, sf)))


def _existing_tags(spark, sf):
    own = F.when(F.col("username") == "src3", F.upper("manual_sentiment")).when(F.col("username") == "src4", "Mixed") \
        .otherwise("")
    return SC.read_existing_tags(_tagged(spark, sf).withColumn("sentiment", own)).select("id", "existing_tag")


def _normalize(spark, sf):
    d = FX.table(spark, sf, "documents").join(FX.table(spark, sf, "labels"), "doc_id", "left")
    short = F.when(F.col("toxic") == 1, "NEG").when(F.col("quality") == 1, "+").when(F.col("quality") == 0, "0") \
        .otherwise(F.upper("lang"))
    return d.select(F.col("doc_id").alias("id"), short.alias("label")).withColumn("normalized", L.normalize_label("label"))


def _fill(spark, sf):
    words = F.when(F.col("username") != "src1", F.col("reply_length"))
    return C.fill_defaults(FX.documents(spark, sf).select("id", "text", "username", words.alias("word_count")))


def _booleans(spark, sf):
    df = _tagged(spark, sf).select("id", F.initcap("is_tagged").alias("is_nested"), F.lit(1).alias("has_text"))
    return C.coerce_booleans(df, ["is_nested", "has_text"])


def _numeric(spark, sf):
    df = FX.documents(spark, sf).select("id", "username", F.regexp_replace("username", "src", "").alias("word_count"))
    return C.coerce_numeric(df, ["username", "word_count"])


def _wide(spark, sf):
    return C.to_wide(FX.predictions(spark, sf), MODELS)


def _metadata(spark, sf):
    metrics = _summary(spark, sf).select("model_name", "accuracy", "f1_weighted")
    p = FX.predictions(spark, sf).select("id", "model_name", "ml_sentiment")
    return rounded(C.attach_metadata(p, metrics, "2025-01-01 00:00:00"))


def _preds(*cols):
    return lambda spark, sf: FX.predictions(spark, sf).select(*cols)


def _stack(spark, sf):
    a = FX.pred_a(spark, sf).withColumn("model_name", F.lit(MODELS[0]))
    b = FX.pred_b(spark, sf).withColumn("model_name", F.lit(MODELS[1]))
    return rounded(C.stack_predictions(a, b))


def _written(spark, name, write):
    path = scratch_path(spark, name)
    write(path)
    return path


def _write_table(spark, sf):
    return spark.read.parquet(_written(spark, "table", lambda p: K.write_table(FX.comments(spark, sf), p)))


def _write_per_model(spark, sf):
    path = _written(spark, "models", lambda p: K.write_per_model(FX.predictions(spark, sf), p))
    return rounded(spark.read.parquet(path), 9)


def _write_ensemble(part):
    """The rows or the performance table, as the files hold them."""
    def run(spark, sf):
        df = _ensembled(spark, sf)
        path = _written(spark, "ensemble", lambda p: K.write_ensemble(df, E.evaluate_ensembles(df), p))
        return rounded(spark.read.parquet(f"{path}/{part}"))
    return run


def _extend(spark, sf):
    """An earlier analysis extended by all nine columns of both models."""
    p = FX.predictions(spark, sf)
    figures = M.summary_metrics(M.evaluable(p)).select("model_name", F.col("accuracy").alias("test_accuracy")).join(
        Q.confidence_stats(p).select("model_name", F.col("mean").alias("avg_training_confidence")), "model_name", "left")
    wide = join_checked(K.per_model_columns(p), figures, "model_name")
    return rounded(J.extend_analysis(FX.documents(spark, sf).select("id", "username"), wide, MODELS))


def _tokens(tokenizer, sep):
    def run(spark, sf):
        d = FX.documents(spark, sf).select("id", tokenizer("text").alias("_t"))
        return d.select("id", F.size("_t").alias("n_tokens"), F.array_join("_t", sep).alias("tokens"))
    return run


def _ngrams(spark, sf):
    d = FE.with_terms(FX.texts(spark, sf).select("id", "text"), preset="features")
    return d.select("id", F.size("terms").alias("n_tokens"), F.array_join("terms", "|").alias("tokens"))


def _reanalyze(spark, sf):
    old = _analyzed(spark, sf, FX.texts).select("id", "text", "final_sentiment")
    return rounded(LX.reanalyze(old, LX.keyword_lexicon(spark)).drop("text"))


def _compare(spark, sf):
    old = _analyzed(spark, sf, FX.texts).select("id", "text", F.col("textblob_sentiment").alias("final_sentiment"))
    return LX.compare_with_original(LX.reanalyze(old, LX.keyword_lexicon(spark)))


def _map_labels(spark, sf):
    names = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive"}
    m = S.map_model_labels("scores", names)
    return rounded(_label_array(spark, sf).select("id", m.alias("m")).select("id", "m.*"))


def _map_binary(spark, sf):
    two = F.array(F.struct(F.lit("LABEL_0").alias("label"), F.col("ml_confidence").alias("score")),
                  F.struct(F.lit("LABEL_1").alias("label"), (F.lit(1.0) - F.col("ml_confidence")).alias("score")))
    df = FX.pred_a(spark, sf).select("id", two.alias("scores"))
    return rounded(df.select("id", S.map_binary_labels("scores").alias("m")).select("id", "m.*"))


def _parse_ts(spark, sf):
    e = FX.table(spark, sf, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return e.select(F.col("event_id").alias("id"), D.parse_timestamp(iso).alias("parsed"))


def _time_features(spark, sf):
    e = FX.table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    return D.time_features(e, "ts").drop("ts")


def _only_tags(spark, sf):
    replies = FX.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return J.ids_only_in_tags(replies, FX.tags(spark, sf))


def _merge_by_order(spark, sf):
    order = ("ml_confidence", "id")
    return rounded(J.merge_by_order(FX.pred_a(spark, sf), FX.pred_b(spark, sf), order, order))


def _report(spark, sf):
    r = Q.analysis_report(_analyzed(spark, sf, FX.texts))
    return rounded(r.select("total_replies", "sentiment_distribution.*", "confidence_distribution.*",
                            "score_statistics.*", *[f"{x}_percentage" for x in ("positive", "negative", "neutral")]))


def _with_prediction(spark, sf, pred=FX.pred_a):
    return FX.documents(spark, sf).join(pred(spark, sf), "id")


def _training_accuracy(spark, sf):
    return rounded(Q.training_accuracy(FX.pred_b(spark, sf).join(FX.tags(spark, sf), "id", "left")))


def _recommend(spark, sf):
    return R.recommendations(_summary(spark, sf), MODELS)


def _winner(spark, sf):
    # Class shares are multiples of 0.0000125, so six digits would round exact halves.
    return rounded(R.winner_columns(FX.predictions(spark, sf), R.pick_winner(_summary(spark, sf), MODELS)), 9)


def _disagree(spark, sf):
    cols = ["ensemble_majority_vote", "ml_sentiment_roberta", "ml_sentiment_gb"]
    return R.disagreements(_ensembled(spark, sf, True), cols).select(
        "id", "ml_sentiment_roberta", "ml_sentiment_gb", "ensemble_majority_vote", "preview")


def _sample_comments(spark, sf):
    df = _with_prediction(spark, sf).join(FX.tags(spark, sf), "id", "left")
    return R.sample_comments(df.select("id", "text", "ml_sentiment", "manual_sentiment"))


def _rule(rule, both=False):
    def run(spark, sf):
        m = rule("ml_sentiment_roberta", "ml_sentiment_gb", "ml_confidence_roberta", "ml_confidence_gb")
        df = FX.merged(spark, sf)
        return rounded(df.select("id", m.alias("m")).select("id", "m.*")) if both else df.select("id", m.alias("sentiment"))
    return run


def _vectors(spark, sf):
    """TF-IDF vectors of all comments, unfolded to their stored entries."""
    v = FE.TextVectorizer("features")
    d = v.fit(FX.texts(spark, sf)).transform(FX.texts(spark, sf))
    return rounded(FE.unfolded(d, v.terms))


def _numeric_block(spark, sf):
    return FE.numeric_block(_analyzed(spark, sf))


def _scaled(spark, sf):
    cols = list(FE.NUMERIC_FEATURES)
    block = materialize(_numeric_block(spark, sf).select("id", *cols))  # read twice; the texts are analysed once
    return rounded(FE.standard_scale(block, cols).select("id", *cols))


def _absolute(spark, sf):
    cols = ["combined_sentiment_score", "vader_compound", "textblob_polarity"]
    return rounded(FE.absolute_features(_analyzed(spark, sf, FX.texts), cols).select("id", *cols))


def _feature_rows(spark, sf):
    """Analysed comments with numeric block and TF-IDF as one vector; the lexicon label is the target."""
    block = FE.choose_target(_numeric_block(spark, sf))
    v = FE.TextVectorizer("features", text="cleaned_text", out="tfidf")
    return FE.assemble_features(v.fit(block).transform(block))


def _assembled(spark, sf):
    stored = F.unwrap_udt("features")
    return rounded(_feature_rows(spark, sf).select(
        "id", "target", F.coalesce(stored["size"], F.size(stored["values"])).alias("width"),
        F.aggregate(stored["values"], F.lit(0.0), lambda a, x: a + x).alias("total")))


def _encoded(spark, sf):
    t = FX.tags(spark, sf)
    return FE.encode_labels(t, FE.label_classes(t)).select("id", "manual_sentiment", "label")


def _predictions_from(*names, preset="punct", **changes):
    """Train on the tagged training rows, predict every comment."""
    def run(spark, sf):
        settings = {n: ML.SETTINGS[preset][n] | changes for n in names}
        c = ML.compare_models(FX.tagged_comments(spark, sf), preset, settings)
        if c.errors:
            raise RuntimeError(str(c.errors))
        return rounded(ML.predict_all(c.models, c.inputs.transform(FX.texts(spark, sf))).select(
            "id", "model_name", "ml_sentiment", "ml_confidence"))
    return run


def _on_features(*names):
    """Train on the training rows of the feature table with the lexicon's label as target, predict every comment."""
    def run(spark, sf):
        settings = {n: ML.SETTINGS["features"][n] for n in names or ML.SETTINGS["features"]}
        c = ML.compare_models(_analyzed(spark, sf), "features", settings)
        if c.errors:
            raise RuntimeError(str(c.errors))
        return c
    return run


def _mlp(spark, sf):
    predicted = _on_features("neural_network")(spark, sf).predictions
    return rounded(predicted.select("id", "model_name", "ml_sentiment", "ml_confidence"))


def _compare_models(spark, sf):
    return rounded(_text_models(spark, sf, "letters").metrics())


def _cross_validate(spark, sf):
    rows, _, classes = ML.training_rows(FX.tagged_comments(spark, sf), "punct")
    train = rows.filter(~F.col("is_test"))
    scores = ML.cross_validate(train, classes, "naive_bayes", ML.SETTINGS["punct"]["naive_bayes"],
                               metric="f1_weighted")
    return rounded(scores)


def _holdout(spark, sf):
    held = _split_predictions(spark, sf).filter("is_test")
    out = ML.predict_holdout(FX.documents(spark, sf).select("id", "username"), held, MODELS[0], "2025-01-01 00:00:00")
    return rounded(out.withColumn("ml_timestamp", F.col("ml_timestamp").cast("string")))


def _facts(c):
    """What must hold of the predictions of a comparison's models: every row once, split before training, the label of the
    largest probability, probabilities that sum to 1, and metrics that the predictions give again."""
    p = c.scored()
    values, test = F.map_values("ml_probs"), F.col("is_test")
    top = F.col("ml_probs")[F.col("ml_sentiment")] == F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    facts = p.groupBy("model_name").agg(
        F.count_distinct("id").alias("ids"), F.count("*").alias("predictions"), F.count_if(test).alias("test_rows"),
        F.count_if(top & (F.col("ml_confidence") == F.array_max(values))).alias("labelled_by_largest"),
        F.count_if(F.abs(total - 1) < 1e-6).alias("summing_to_1"),
        (F.count_if(test & (F.col("ml_sentiment") == F.col("manual_sentiment"))) / F.count_if(test)).alias("again"))
    same = F.abs(F.col("again") - F.col("test_accuracy")) < 1e-12
    return facts.join(c.metrics().select("model_name", "test_accuracy", "auc"), "model_name").select(
        *[x for x in facts.columns if x != "again"], same.alias("accuracy_again"), "auc")


def _feature_facts(spark, sf):
    """The facts of all seven models on the feature table; the lexicon's label can be learned, so all beat chance."""
    return _facts(_on_features()(spark, sf)).withColumn("better_than_chance", F.col("auc").between(0.5, 1.0)).drop("auc")


def _text_models(spark, sf, preset, *names):
    settings = {n: ML.SETTINGS[preset][n] for n in names or ML.SETTINGS[preset]}
    c = ML.compare_models(FX.tagged_comments(spark, sf), preset, settings)
    if c.errors:
        raise RuntimeError(str(c.errors))
    return c


def _trained_report(spark, sf):
    """Train on the training rows, predict every comment, evaluate on the held-out rows and report."""
    c = _text_models(spark, sf, "punct", "naive_bayes")
    return rounded(_model_report(RP.model_summary(RP.trained_predictions(c, FX.texts(spark, sf)))))


def _scored(spark, sf):
    out = ML.score_with_batch_model(FX.documents(spark, sf).select("id", "text"), scorer.load, scorer.LABELS,
                                    mapping=scorer.MAPPING)
    return rounded(out.drop("text"))


def _embeddings(spark, sf):
    return FX.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _knn(find):
    """Every vector against all others."""
    def run(spark, sf):
        e = _embeddings(spark, sf)
        return rounded(find(e.select("id", "embedding"), e, 5, True))
    return run


def _model_report(r):
    """Every field of the model reports as a column."""
    q, a, p = "data_quality", "prediction_analysis", "performance_metrics"
    cells = F.transform(f"{p}.confusion_matrix", lambda c: F.concat_ws(":", c["truth"], c["pred"], c["n"]))
    labels = []
    for c in ("negative", "neutral", "positive"):
        labels += [F.col(f"{a}.sentiment_distribution")[c].alias(c), F.col(f"{a}.sentiment_percentages")[c].alias(f"{c}_percent")]
        labels += [F.col(f"{p}.per_class_metrics")[c][m].alias(f"{c}_{m}") for m in ("precision", "recall", "f1", "support")]
    return r.select(
        "model_name", "total_predictions", f"{q}.*", *labels,
        *[F.col(f"{a}.confidence_stats.{c}").alias(f"confidence_{c}") for c in ("mean", "std", "min", "max")],
        f"{a}.confidence_stats.high_confidence", f"{a}.confidence_stats.high_confidence_percent", f"{p}.metrics.*",
        F.array_join(cells, ",").alias("confusion_matrix"), *([f"{p}.cross_validation.*"] if "cross_validation" in str(r.schema) else []))


def _summary_report(spark, sf):
    return rounded(_model_report(RP.model_summary(FX.predictions(spark, sf), M.cv_summary(_fold_scores(spark, sf)))))


def _master_columns(r):
    """Every field of the master report as a column; the figures of each family's models one after the other."""
    s = "performance_summary"
    figures = ("support", "accuracy", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted", "f1_macro", "f1_weighted")

    def family(name):
        models = F.col(f"{s}.{name}_models")
        return [F.array_join(models["model_name"], ",").alias(name), *[F.aggregate(
            models[f].cast("array<double>"), F.lit(0.0), lambda x, y: x + y).alias(f"{name}_{f}") for f in figures]]
    ranked = [F.array_join(F.col("model_rankings")[f"by_{m}"], ",").alias(f"by_{m}") for m in ("f1_weighted", "accuracy", "f1_macro")]
    return rounded(r.select(f"{s}.total_models_evaluated", *family("traditional"), *family("neural"), *ranked,
                            F.array_join("recommendations", "|").alias("recommendations")))


def _master_report(spark, sf):
    return _master_columns(RP.master_report(FX.predictions(spark, sf), MODELS))


def _write_reports(document):
    """The report as the JSON file holds it."""
    def run(spark, sf):
        p, path = FX.predictions(spark, sf), scratch_path(spark, "reports")
        K.write_reports(RP.master_report(p, MODELS, ML.SETTINGS), f"{path}/master")
        K.write_reports(RP.model_summary(p), f"{path}/models")
        read = spark.read.json(f"{path}/{document}")
        return rounded(_model_report(read)) if document == "models" else _master_columns(read)
    return run


def trained_queries():
    """Queries that train models or search neighbours."""
    return {
        "tfidf_sql": lambda s, d: rounded(FE.tfidf_sql(FX.texts(s, d), stop_words=X.english_stop_words())),
        "tfidf_vector": _vectors,
        "assemble_features": _assembled,
        "standard_scale": _scaled,
        "absolute_features": _absolute,
        "encode_labels": _encoded,
        "choose_target": lambda s, d: FE.choose_target(_analyzed(s, d, FX.texts)).select("id", "target"),
        "class_weights": lambda s, d: rounded(FE.class_weights(FX.tags(s, d)).select("id", "manual_sentiment", "weight")),
        "stratified_split": lambda s, d: stratified_split(FX.tags(s, d)).select("id", "manual_sentiment", "is_test"),
        "stratified_folds": lambda s, d: stratified_folds(FX.tags(s, d)).select("id", "manual_sentiment", "fold"),
        "train_logistic": _predictions_from("logistic_regression"),
        "train_random_forest": _predictions_from("random_forest"),
        "train_gradient_boosting": _predictions_from("gradient_boosting", preset="social"),
        "train_svm": _predictions_from("svm"),
        "train_naive_bayes": _predictions_from("naive_bayes"),
        "train_mlp": _mlp,
        "predict_all": _predictions_from("logistic_regression", "naive_bayes"),
        "predict_holdout": _holdout,
        "compare_models": _compare_models,
        "compare_feature_models": lambda s, d: rounded(_on_features()(s, d).metrics()),
        "feature_model_facts": _feature_facts,
        "social_model_facts": lambda s, d: _facts(_text_models(s, d, "social")).drop("auc"),
        "trained_report": _trained_report,
        "train_knn": lambda s, d: rounded(_on_features("knn")(s, d).predictions.select(
            "id", "model_name", "ml_sentiment", "ml_confidence", "is_test")),
        "cross_validate": _cross_validate,
        "score_with_batch_model": _scored,
        "knn_candidates": _knn(N.knn_candidates),
        "knn_classify": _knn(N.knn_classify),
        "model_summary": _summary_report,
        "master_report": _master_report,
        "results_summary": lambda s, d: rounded(RP.results_summary(
            _summary(s, d), M.cv_summary(_fold_scores(s, d)).drop("folds"), MODELS)),
        "write_reports": _write_reports("models"),
        "write_master_report": _write_reports("master"),
    }


def all_queries():
    return sql_queries() | trained_queries()


def sql_queries():
    docs, preds = FX.documents, FX.predictions
    return {
        # Sources
        "read_comments": _read_comments,
        "flatten_reply_pages": _flatten,
        "training_gate": lambda s, d: C.training_gate(FX.tags(s, d)),
        "read_existing_tags": _existing_tags,
        # Sinks
        "write_table": _write_table,
        "write_per_model": _write_per_model,
        "export_tagged": lambda s, d: J.export_tagged(docs(s, d), FX.tags(s, d)),
        "extend_analysis": _extend,
        "write_ensemble": _write_ensemble("rows"),
        "write_ensemble_performance": _write_ensemble("performance"),
        # Projections, filters, coercions
        "fill_defaults": _fill,
        "coerce_booleans": _booleans,
        "coerce_numeric": _numeric,
        "tagged_only": lambda s, d: C.tagged_only(_tagged(s, d)).select("id", "username", "manual_sentiment"),
        "untagged_only": lambda s, d: C.untagged_only(_tagged(s, d)).select("id", "username", "manual_sentiment"),
        "add_length_flags": lambda s, d: C.add_length_flags(docs(s, d)).select("id", "reply_length", "has_text"),
        "select_available": lambda s, d: C.select_available(FX.comments(s, d)),
        "normalize_label": _normalize,
        "preview": _text("preview", lambda t: L.preview(t, 100), strip=False),
        "to_long": lambda s, d: rounded(C.to_long(_wide(s, d), MODELS)),
        "to_wide": lambda s, d: rounded(_wide(s, d)),
        "attach_metadata": _metadata,
        "mark_mismatch": lambda s, d: C.mark_mismatch(preds(s, d)).select(
            "id", "model_name", "ml_sentiment", "manual_sentiment", "mismatch"),
        "filter_model": lambda s, d: C.filter_model(preds(s, d), MODELS[1]).select("id", "model_name", "ml_sentiment"),
        "algorithm_names": lambda s, d: C.algorithm_names(preds(s, d)),
        "stack_predictions": _stack,
        # Text
        "count_emoji_runs": _text("emoji_count", X.count_emoji_runs),
        "extract_emojis": _text("emojis", X.extract_emojis),
        "strip_emojis": _text("cleaned_text", X.strip_emojis),
        "count_keywords": lambda s, d: docs(s, d).select("id", X.clean_input("text").alias("t")).select(
            "id", X.count_keywords("t", X.POSITIVE_KEYWORDS).alias("positive_keywords"),
            X.count_keywords("t", X.NEGATIVE_KEYWORDS).alias("negative_keywords")),
        "has_question": _text("has_question", X.has_question),
        "has_exclamation": _text("has_exclamation", X.has_exclamation),
        "has_caps": _text("has_caps", X.has_caps),
        "word_count": _text("word_count", lambda t: X.word_count(X.strip_emojis(t))),
        "char_count": _text("char_count", X.char_count),
        "text_features": lambda s, d: X.text_features(FX.texts(s, d)).drop("text", "username", "reply_length"),
        "preprocess_letters": _text("processed", X.preprocess_letters, strip=False),
        "preprocess_social": _text("processed", X.preprocess_social, strip=False),
        "preprocess_punct": _text("processed", X.preprocess_punct, strip=False),
        "tokenize_words": _tokens(X.tokenize_words, " "),
        "tokenize_ngrams": _ngrams,
        # Sentiment
        "lexicon_score": lambda s, d: rounded(
            LX.lexicon_score(FX.texts(s, d), LX.keyword_lexicon(s)).select("id", *LX.SCORES)),
        "lexicon_score_joined": _lexicon_joined,
        "lexicon_score_dictionary": lambda s, d: _lexicon_joined(s, d, LX.DICTIONARY_BYTES),
        "classify_compound": _from_analysis("vader_sentiment"),
        "classify_polarity": _from_analysis("textblob_sentiment"),
        "combined_score": _from_analysis("combined_sentiment_score"),
        "final_sentiment": _from_analysis("final_sentiment"),
        "confidence_band": _from_analysis("confidence"),
        "analyze_comments": lambda s, d: rounded(_analyzed(s, d)),
        "reanalyze": _reanalyze,
        "compare_with_original": _compare,
        "map_model_labels": _map_labels,
        "map_binary_labels": _map_binary,
        # Time
        "parse_timestamp": _parse_ts,
        "time_features": _time_features,
        # Joins
        "merge_tags": _tagged,
        "ids_only_in_tags": _only_tags,
        "ids_only_in_comments": lambda s, d: J.ids_only_in_comments(docs(s, d), FX.tags(s, d)),
        "merge_model_outputs": lambda s, d: rounded(J.merge_model_outputs(FX.pred_a(s, d), FX.pred_b(s, d))),
        "merge_by_order": _merge_by_order,
        # Aggregations and data quality
        "label_distribution": lambda s, d: rounded(Q.label_distribution(_analyzed(s, d, FX.texts))),
        "distribution_3": lambda s, d: Q.distribution_3(FX.pred_a(s, d)),
        "confidence_distribution": lambda s, d: rounded(Q.confidence_distribution(_analyzed(s, d, FX.texts))),
        "score_statistics": lambda s, d: rounded(Q.score_statistics(_analyzed(s, d, FX.texts))),
        "analysis_report": _report,
        "reply_statistics": lambda s, d: rounded(Q.reply_statistics(docs(s, d))),
        "tag_progress": lambda s, d: rounded(Q.tag_progress(_tagged(s, d))),
        "validate_merged": lambda s, d: rounded(Q.validate_merged(_tagged(s, d))),
        "merge_summary": lambda s, d: Q.merge_summary(_tagged(s, d)),
        "data_quality_summary": lambda s, d: rounded(Q.data_quality_summary(preds(s, d))),
        "prediction_distribution": lambda s, d: rounded(Q.prediction_distribution(preds(s, d))),
        "confidence_stats": lambda s, d: rounded(Q.confidence_stats(preds(s, d))),
        "model_agreement": lambda s, d: rounded(Q.model_agreement(FX.merged(s, d))),
        "agreement_matrix": lambda s, d: rounded(
            Q.agreement_matrix(_ensembled(s, d), E.method_columns(_ensembled(s, d)))),
        "term_frequency": lambda s, d: Q.term_frequency(FX.texts(s, d)),
        "term_frequency_negative": lambda s, d: Q.term_frequency(_with_prediction(s, d), sentiment="negative"),
        "training_accuracy": _training_accuracy,
        # Metrics
        "confusion_matrix": lambda s, d: M.confusion_matrix(_eval(s, d)),
        "dashboard_confusion": lambda s, d: M.dashboard_confusion(preds(s, d)),
        "class_metrics": lambda s, d: rounded(M.class_metrics(_eval(s, d))),
        "summary_metrics": lambda s, d: rounded(_summary(s, d)),
        "weighted_f1_3": lambda s, d: rounded(M.weighted_f1_3(preds(s, d))),
        "accuracy_normalized": lambda s, d: rounded(M.accuracy_normalized(preds(s, d))),
        "auc_ovr_weighted": lambda s, d: rounded(M.auc_ovr_weighted(preds(s, d))),
        "evaluate_pretrained": lambda s, d: rounded(M.evaluate_pretrained(preds(s, d))),
        "evaluate_ensembles": lambda s, d: rounded(E.evaluate_ensembles(_ensembled(s, d))),
        "fold_accuracy": lambda s, d: rounded(_fold_scores(s, d)),
        "cv_summary": lambda s, d: rounded(M.cv_summary(_fold_scores(s, d))),
        # Windows, rankings, samples
        "sample_per_class": lambda s, d: R.sample_per_class(C.tagged_only(_tagged(s, d)), 3).select(
            "id", "username", "manual_sentiment", "rank"),
        "rank_models": lambda s, d: rounded(R.rank_models(_summary(s, d), MODELS)),
        "pick_winner": lambda s, d: rounded(R.pick_winner(_summary(s, d), MODELS)),
        "winner_columns": _winner,
        "split_accuracy": lambda s, d: rounded(R.split_accuracy(_split_predictions(s, d))),
        "model_gap": lambda s, d: rounded(R.model_gap(
            R.split_accuracy(_split_predictions(s, d)), MODELS[1], MODELS[0])),
        "recommendations": _recommend,
        "disagreements": _disagree,
        "sample_comments": _sample_comments,
        "untagged_batch": lambda s, d: R.untagged_batch(docs(s, d), FX.tags(s, d), 900, 25),
        # Ensembles
        "majority_vote": _rule(E.majority_vote),
        "weighted_average": _rule(E.weighted_average, True),
        "confidence_weighted": _rule(E.confidence_weighted, True),
        "stacked": _rule(E.stacked),
        "adaptive": _rule(E.adaptive),
        "run_ensembles": lambda s, d: rounded(_ensembled(s, d)),
        "method_comparison": lambda s, d: rounded(E.method_comparison(_ensembled(s, d))),
    }
