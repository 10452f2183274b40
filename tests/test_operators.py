import hashlib
import random

import pytest
from pyspark.sql import functions as F

from commentlake.operators import clean as C, ensemble as E, lexicon as LX, merge as J, metrics as M, quality as Q, scale as SC
from commentlake.operators.features import stratified_folds, stratified_split
from commentlake.operators.scale import hash_cuts, key_hash
from commentlake.session import scratch_path
from commentlake.sources.comments import read_comments
from commentlake.sources.pages import flatten_reply_pages, read_reply_pages
from commentlake.streaming.replies import stream_replies, write_replies


def test_join_checked_falls_back(spark):
    big, small = spark.range(100), spark.range(50).withColumn("v", F.lit(1))
    for limit in (10, 1000):
        joined = SC.join_checked(big, small, "id", "left", max_rows=limit)
        assert joined.filter("v = 1").count() == 50 and joined.count() == 100


def test_global_position_matches_a_sort(spark):
    values = [(random.Random(i).randint(0, 20), i) for i in range(500)]
    df = spark.createDataFrame(values, "v int, id int")
    got = {r["id"]: r["position"] for r in SC.global_position(df, ["v", "id"], partitions=7).collect()}
    assert got == {i: n + 1 for n, (v, i) in enumerate(sorted(values))}


def test_quantiles_with_a_hot_value(spark):
    values = [0.5] * 200 + [i / 100 for i in range(100)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = Q.score_statistics(df, "x").first()
    import numpy as np
    a = np.array([v for v in values if v is not None])
    want = [len(a), a.mean(), a.std(ddof=1), a.min(), *np.percentile(a, [25, 50, 75]), a.max()]
    assert [round(float(x), 9) for x in got] == [round(float(x), 9) for x in want]
    rough = Q.score_statistics(df, "x", approximate=True).first()
    assert rough["count"] == 300 and rough["q50"] == 0.5


def test_stratified_split_and_folds(spark):
    labels = ["a"] * 300 + ["b"] * 30 + ["c"] * 2
    df = spark.createDataFrame(list(enumerate(labels)), "id long, manual_sentiment string")
    split = stratified_split(df).collect()
    for label in "abc":
        ids = sorted((r["id"] for r in split if r["manual_sentiment"] == label),
                     key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        assert {r["id"] for r in split if r["manual_sentiment"] == label and r["is_test"]} == set(ids[: round(0.2 * len(ids))])
    folds = stratified_folds(df).groupBy("manual_sentiment", "fold").count().collect()
    sizes = {x: [r["count"] for r in folds if r["manual_sentiment"] == x] for x in "ab"}
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in sizes.values())
    hot = df.unionByName(df.filter("id = 0").crossJoin(spark.range(400).select()))
    assert hot.count() == stratified_split(hot).count()
    assert stratified_split(hot).filter("id = 0").select("is_test").distinct().count() == 1


def test_merge_keeps_rows_and_fans_out(spark):
    comments = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "id long, text string")
    tags = spark.createDataFrame([(1, "positive"), (1, "negative"), (9, "neutral"), (None, "neutral")],
                                 "id long, manual_sentiment string")
    out = J.merge_tags(comments, tags).collect()
    assert sorted((r["id"] or 0, r["text"], r["manual_sentiment"] or "") for r in out) == [
        (0, "c", ""), (1, "a", "negative"), (1, "a", "positive"), (2, "", "")]
    assert [r[0] for r in J.ids_only_in_tags(comments, tags).collect()] == [9]
    assert [r[0] for r in J.ids_only_in_comments(comments, tags).collect()] == [2]
    with pytest.raises(ValueError):
        J.merge_model_outputs(spark.range(1).toDF("x"), spark.range(1).toDF("y"))


def test_validate_merged(spark):
    df = spark.createDataFrame([(1, "ab", "positive"), (1, "", "odd"), (None, None, ""), (None, "abc", None)],
                               "id long, text string, manual_sentiment string")
    got = {(r["check"], r["item"]): r["value"] for r in Q.validate_merged(df).collect()}
    assert got == {("duplicate_ids", None): 2, ("empty_text", None): 2, ("tagged_with_empty_text", None): 1,
                   ("mean_length", None): 1.25, ("min_length", None): 0, ("max_length", None): 3,
                   ("label", "positive"): 1, ("unusual_label", "odd"): 1}


def test_ensemble_ties_and_nulls(spark):
    rows = [("p", "n", 0.5, 0.5), ("p", "p", 0.1, 0.9), ("p", "n", 0.9, 0.2), ("p", "n", 0.81, 0.8), ("p", "n", 0.3, 0.3),
            ("p", "n", 0.31, 0.3), (None, "n", 0.9, 0.1)]
    cols = "ml_sentiment_roberta string, ml_sentiment_gb string, ml_confidence_roberta double, ml_confidence_gb double"
    out = E.run_ensembles(spark.createDataFrame(rows, cols)).collect()
    assert [r["ensemble_majority_vote"] for r in out] == ["n", "p", "p", "p", "n", "p", None]
    assert [r["ensemble_confidence_weighted"] for r in out] == ["n", "p", "p", "p", "n", "p", None]
    assert [r["ensemble_stacked"] for r in out] == ["n", "p", "p", "n", "n", "n", None]
    assert [r["ensemble_adaptive"] for r in out] == ["n", "p", "n", "p", "n", "p", None]
    bare = spark.createDataFrame([("p", "n"), ("n", "n")], "ml_sentiment_roberta string, ml_sentiment_gb string")
    assert [r["ensemble_majority_vote"] for r in E.run_ensembles(bare).collect()] == ["p", "n"]


def test_metrics_with_a_class_never_predicted(spark):
    rows = [("m", "a", "a"), ("m", "b", "a"), ("m", "c", "c"), ("m", None, "a"), ("m", " ", "a")]
    df = spark.createDataFrame(rows, "model_name string, manual_sentiment string, ml_sentiment string")
    ok = M.evaluable(df)
    s = M.summary_metrics(ok).first()
    assert s["support"] == 3 and abs(s["accuracy"] - 2 / 3) < 1e-12
    assert abs(s["f1_macro"] - (2 / 3 + 0 + 1) / 3) < 1e-12
    assert M.confusion_matrix(ok).count() == 9
    assert M.class_metrics(ok).filter("label = 'b'").first()["precision"] == 0.0


def test_auc_binary(spark):
    rows = [("m", "n", "n", {"n": 0.9, "p": 0.1}), ("m", "p", "p", {"n": 0.2, "p": 0.8}),
            ("m", "p", "n", {"n": 0.9, "p": 0.1}), ("m", "n", "n", {"n": 0.7, "p": 0.3})]
    df = spark.createDataFrame(rows, "model_name string, manual_sentiment string, ml_sentiment string, ml_probs map<string,double>")
    # Positive scores .8 and .1 against negatives .1 and .3: wins 2 + tie 0.5 of 4.
    assert abs(M.auc_ovr_weighted(df).first()["auc"] - 2.5 / 4) < 1e-12


def test_large_lexicon_path_equals_inline(spark):
    lex = LX.keyword_lexicon(spark)
    df = spark.createDataFrame([(1, "love love hate it"), (2, "love love hate it"), (3, ""), (4, None), (5, "plain words")],
                               "id long, text string")
    inline = LX.lexicon_score(df, lex).select("id", *LX.SCORES).orderBy("id").collect()
    joined = LX.lexicon_score(df, lex, inline_terms=3).select("id", *LX.SCORES).orderBy("id").collect()
    assert [[round(x, 9) for x in r] for r in inline] == [[round(float(x), 9) for x in r] for r in joined]
    assert inline[3]["vader_neutral"] == 1.0 and inline[0]["textblob_subjectivity"] == 1.0


def test_blank_text_is_neutral_and_low(spark):
    df = spark.createDataFrame([(1, None), (2, "  ")], "id long, text string")
    for r in LX.analyze_comments(df, LX.keyword_lexicon(spark)).collect():
        assert (r["final_sentiment"], r["confidence"], r["has_text"], r["char_count"]) == ("neutral", "low", False, 0)


def test_coercions(spark):
    df = spark.createDataFrame([("True", "1.5"), ("yes", "x"), (None, None), ("0", "")], "b string, n string")
    out = C.coerce_numeric(C.coerce_booleans(df, ["b"]), ["n"]).collect()
    assert [(r["b"], r["n"]) for r in out] == [(True, 1.5), (True, 0.0), (False, 0.0), (False, 0.0)]


def test_csv_with_quotes_lines_and_missing_tokens(spark):
    path = scratch_path(spark, "csv-test")
    rows = spark.createDataFrame([('1,"a ""b""\nc",NA,2025-01-01T00:00:00Z',), ('2,None,u,never',)], "value string")
    header = spark.createDataFrame([("id,text,username,timestamp",)], "value string")
    header.unionByName(rows).coalesce(1).write.text(path)
    out = {r["id"]: r for r in read_comments(spark, path).collect()}
    assert out[1]["text"] == 'a "b"\nc' and out[1]["username"] is None and out[1]["timestamp"].year == 2025
    assert out[2]["text"] is None and out[2]["timestamp"] is None
    assert {r["text"] for r in read_comments(spark, path, na_tokens=False).collect()} == {'a "b"\nc', "None"}
    with pytest.raises(ValueError):
        read_comments(spark, path, required=("text", "manual_sentiment"))


def test_pages_batch_and_stream(spark):
    path, out, check = (scratch_path(spark, n) for n in ("pages", "replies", "check"))
    page = '{"data":[{"id":1,"text":"a","timestamp":"2025-01-01T00:00:00Z"},{"id":2,"text":"b","timestamp":"2025-01-01T00:00:01Z"}]}'
    spark.createDataFrame([(page,), (page,), ('{"paging":{}}',)], "value string").coalesce(1).write.text(path)
    assert flatten_reply_pages(read_reply_pages(spark, path)).count() == 4
    write_replies(stream_replies(spark, path), out, check).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_late_page_is_kept(spark, tmp_path):
    import json

    pages, out, check = str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "check")
    for n, (reply_id, day) in enumerate([(2, "2025-08-20"), (1, "2025-08-14")]):
        (tmp_path / "pages").mkdir(exist_ok=True)
        reply = {"id": reply_id, "text": "t", "username": "u", "timestamp": f"{day}T10:00:00+0000", "permalink": "p"}
        (tmp_path / "pages" / f"{n}.json").write_text(json.dumps({"data": [reply]}))
        write_replies(stream_replies(spark, pages), out, check).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_repeated_terms_score_alike_in_both_branches(spark):
    lex = spark.createDataFrame([("good", 1.0, 1.0), ("good", 3.0, 0.0), ("bad", -1.0, None), ("bad", None, 1.0), (None, 1.0, 1.0)],
                                "term string, valence double, subjectivity double")
    df = spark.createDataFrame([(1, "good bad good")], "id long, text string")
    inline, joined = (LX.lexicon_score(df, lex, inline_terms=n).select(*LX.SCORES).first() for n in (100, 1))
    assert [round(x, 9) for x in inline] == [round(float(x), 9) for x in joined]
    assert inline["vader_neutral"] >= 0


def test_cuts_do_not_depend_on_the_bucket_bound(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(600)] + [(7, "a")] * 200
    keyed = spark.createDataFrame(rows, "id long, g string").withColumn("h", key_hash("id", 1))
    wide, tiny = ({(r["g"], r["cut"]): r["upper"] for r in hash_cuts(keyed, "g", "h", [0.2, 0.5, 0.9], **o).collect()}
                  for o in ({}, {"bucket_hex": 1, "most": 1}))
    assert wide == tiny and len(wide) == 6


def test_rows_without_label_and_tiny_classes_are_split(spark):
    rows = [(i, None) for i in range(50)] + [(100, "one"), (200, "two"), (201, "two")]
    df = spark.createDataFrame(rows, "id long, manual_sentiment string")
    tests = {r["manual_sentiment"]: r["n"] for r in stratified_split(df, min_test=1).groupBy("manual_sentiment").agg(
        F.sum(F.col("is_test").cast("int")).alias("n")).collect()}
    assert tests == {None: 10, "one": 0, "two": 1}
    folds = stratified_folds(df).filter("manual_sentiment IS NULL").groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in folds) == [(i, 10) for i in range(5)]


def test_null_and_hot_ids_are_spread(spark):
    # Half the ids are null, one id holds a third of the rows.
    ids = F.when(F.col("i") % 2 == 0, None).when(F.col("i") % 6 < 5, 7).otherwise(F.col("i"))
    comments = spark.range(60_000).withColumnRenamed("id", "i").select(ids.alias("id"), F.concat(F.lit("t"), "i").alias("text"))
    tags = spark.createDataFrame([(7, "positive", "yes"), (11, "neutral", "yes"), (None, "negative", "yes")],
                                 "id long, manual_sentiment string, is_tagged string")
    plain = {r["manual_sentiment"]: r["n"] for r in comments.join(tags, "id", "left").groupBy("manual_sentiment").agg(
        F.count("*").alias("n")).collect()}
    for share in (None, 0.1):
        merged = J.merge_tags(comments, tags, hot_share=share)
        assert {r["manual_sentiment"]: r["n"] for r in merged.groupBy("manual_sentiment").agg(F.count("*").alias("n")).collect()} == plain
        assert merged.select("text").distinct().count() == 60_000 and merged.columns == ["id", "text", "manual_sentiment", "is_tagged"]
    assert SC.hot_keys(comments, "id", 0.1) == [7]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = J.merge_tags(comments, tags, hot_share=0.1).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in parts) < 0.3 * 60_000


def test_pairs_need_a_name_for_each_row(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "text string, p int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), (None, 4)], "text string, p int")
    assert sorted((r["text"], r["p_roberta"], r["p_gb"]) for r in J.merge_model_outputs(a, b).collect()) == [
        ("x", 1, 1), ("x", 2, 1), ("y", 3, 2), ("y", 3, 3)]
    with pytest.raises(ValueError, match="both sides"):
        J.merge_model_outputs(a, a)
    with pytest.raises(ValueError, match="repeats"):
        J.merge_by_order(a, b, ["text"], ["p"])


def test_few_wide_rows_are_not_broadcast(spark):
    big = spark.range(1000).select((F.col("id") % 5).alias("k"))
    wide = spark.range(5).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1_000_000).alias("v"))
    both = [SC.join_checked(big, wide, "k", max_bytes=n).select("k", F.length("v").alias("n")) for n in (1 << 30, 1 << 20)]
    assert sorted(both[0].collect()) == sorted(both[1].collect())
    hints = ["ResolvedHint" in j._jdf.queryExecution().analyzed().toString() for j in both]
    assert hints == [True, False]


def test_large_lexicons_score_as_literals_do(spark):
    df = spark.createDataFrame([(1, "love love hate"), (2, None), (3, ""), (4, "nothing known"), (5, "love " * 3000), (5, "hate")], "id long, text string")
    lex = spark.createDataFrame([("love", 1.0, 1.0), ("love", 2.0, None), ("hate", -1.5, 0.5), (None, 1.0, 1.0), ("x", None, 1.0)],
                                "term string, valence double, subjectivity double")
    ways = [dict(), dict(inline_terms=0), dict(inline_terms=0, max_bytes=0)]
    literal, dictionary, joined = (sorted(LX.lexicon_score(df, lex, **w).select("id", "text", *LX.SCORES).collect(), key=str) for w in ways)
    for a, b, c in zip(literal, dictionary, joined):
        assert a[:2] == b[:2] == c[:2] and all(abs(x - y) < 1e-9 and abs(x - z) < 1e-9 for x, y, z in zip(a[2:], b[2:], c[2:]))
    assert LX.lexicon_score(df, lex.limit(0), inline_terms=-1).count() == 6
