from pyspark.sql import functions as F

from commentlake.functions import labels as L, sentiment as S, text as X, times as D


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expr("x").alias("y"), "i").orderBy("i").select("y").collect()]


def test_emoji_runs(spark):
    texts = ["a😀😀b😀", "👩‍👩 x", "漢字 and ─", "plain", None, ""]
    assert one(spark, texts, lambda c: X.count_emoji_runs(X.clean_input(c))) == [2, 1, 2, 0, 0, 0]
    assert one(spark, texts, lambda c: X.extract_emojis(X.clean_input(c)))[:3] == ["😀😀😀", "👩‍👩", "漢字─"]
    assert one(spark, [" 😀 hi 😀 "], lambda c: X.strip_emojis(X.clean_input(c))) == ["hi"]


def test_caps(spark):
    texts = ["NO WAY", "OK", "A1B2", "it is a1B2", "ÉTÉ", "ßAB", "123", "x LOUD y", "(ABC)", "ǅAB", None]
    assert one(spark, texts, lambda c: X.has_caps(X.clean_input(c))) == [
        True, False, True, False, True, False, False, True, True, False, False]


def test_keywords(spark):
    count = lambda words, mode="substring": lambda c: X.count_keywords(X.clean_input(c), words, mode)
    texts = ["I know", "ridiculous", "Well done, LOVE it", "   ", None]
    assert one(spark, texts, count(X.NEGATIVE_KEYWORDS)) == [1, 2, 0, 0, 0]
    assert one(spark, texts, count(X.POSITIVE_KEYWORDS)) == [0, 0, 2, 0, 0]
    assert one(spark, ["I know no"], count(X.NEGATIVE_KEYWORDS, "token")) == [1]


def test_word_and_char_counts(spark):
    texts = ["  a  b c ", "", " \t\n", "one", None]
    assert one(spark, texts, lambda c: X.word_count(X.clean_input(c))) == [3, 0, 0, 1, 0]
    assert one(spark, ["😀é"], X.char_count) == [2]


def test_preprocess(spark):
    text = ["See https://x.y/z NOW!! @me #tag Café, it's 5% ok"]
    assert one(spark, text, X.preprocess_letters) == ["see https x y z now me tag caf it s ok"]
    assert one(spark, text, X.preprocess_social) == ["see now!! caf , it s ok"]
    assert one(spark, text, X.preprocess_punct) == ["see https x.y z now!! @me #tag café, it s 5% ok"]
    assert one(spark, [None, ""], X.preprocess_punct) == ["", ""]


def test_tokens(spark):
    assert one(spark, ["The cat's http://a.b food www RT food12 é"], X.tokenize_words) == [["cat's", "food", "food12"]]
    terms = lambda c: X.add_bigrams(X.tokenize_terms(c, ["the"]))
    assert one(spark, ["the cat a sat", "cat", ""], terms) == [["cat", "sat", "cat sat"], ["cat"], []]


def test_classification_edges(spark):
    scores = [0.1, -0.1, 0.0999, -0.0999, 0.11, -0.11]
    assert one(spark, scores, S.classify_compound, "double") == [
        "positive", "negative", "neutral", "neutral", "positive", "negative"]
    assert one(spark, scores, S.classify_polarity, "double") == [
        "neutral", "neutral", "neutral", "neutral", "positive", "negative"]
    assert one(spark, [0.3, 0.31, -0.31, 0.1, 0.11], S.confidence_band, "double") == [
        "medium", "high", "high", "low", "medium"]


def test_final_sentiment(spark):
    rows = [(0.05, 0, 0, 0), (0.051, 0, 9, 0), (-0.051, 9, 0, 0), (0.03, 1, 0, 0), (0.03, 0, 1, 1), (0.03, 1, 1, 1),
            (-0.03, 0, 0, 1), (0.02, 5, 0, 5), (-0.03, 2, 1, 0)]
    df = spark.createDataFrame(rows, "s double, p int, n int, e int")
    got = [r[0] for r in df.select(S.final_sentiment("s", "p", "n", "e")).collect()]
    assert got == ["neutral", "positive", "negative", "positive", "negative", "positive", "neutral", "neutral", "positive"]


def test_model_label_mapping(spark):
    kind = "array<struct<label:string,score:double>>"
    three = [[("LABEL_0", 0.4), ("LABEL_2", 0.4)], [("LABEL_9", 0.9)], [("Positive", 1.0)], []]
    got = one(spark, three, lambda c: S.map_model_labels(c, {"LABEL_0": "negative", "LABEL_2": "positive"}), kind)
    assert [g and g["sentiment"] for g in got] == ["negative", "neutral", "positive", None]
    two = [[("LABEL_0", 0.425), ("LABEL_1", 0.575)], [("LABEL_0", 0.6), ("LABEL_1", 0.4)],
           [("LABEL_0", 0.45), ("LABEL_1", 0.55)], [("A", 0.5), ("B", 0.5)]]
    got = one(spark, two, S.map_binary_labels, kind)
    assert [g and (g["sentiment"], g["confidence"]) for g in got] == [
        ("neutral", 0.5) if abs(0.575 - 0.425) < 0.15 else ("positive", 0.575), ("negative", 0.6), ("neutral", 0.5), None]


def test_labels(spark):
    raw = ["pos", " + ", "Neg", "-", "0", "neu", "other", "", "  ", None]
    assert one(spark, raw, L.normalize_label) == [
        "positive", "positive", "negative", "negative", "neutral", "neutral", "other", None, None, None]
    assert one(spark, ["abc", "abcd", None], lambda c: L.preview(c, 3)) == ["abc", "abc...", None]
    assert one(spark, ["x", "", None], L.is_tagged) == [True, False, False]


def test_times(spark):
    got = one(spark, ["2025-08-26T16:49:18Z", "2025-08-26T16:49:18+02:00", "soon", None],
              lambda c: F.date_format(D.parse_timestamp(c), "HH:mm"))
    assert got == ["16:49", "14:49", None, None]
    df = D.time_features(spark.sql("SELECT timestamp'2025-08-30 05:00:00' AS timestamp"))
    assert df.select("hour", "day_of_week", "is_weekend").first() == (5, 5, 1)
