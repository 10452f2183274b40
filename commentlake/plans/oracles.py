"""DuckDB twins of the registered queries, over the same tables."""

from commentlake.functions.text import (
    EMOJI, NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS, REPORT_STOP_WORDS, SPACE, english_stop_words)
from commentlake.schema import LABELS, NA_TOKENS

WA, WB = 0.784, 0.801


def q(s):
    return "'" + s.replace("'", "''") + "'"


def sql_list(items):
    return "[" + ", ".join(q(x) for x in items) + "]"


def in_list(items):
    return "(" + ", ".join(q(x) for x in items) + ")"


def r(expr, digits=6):
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def dbl(x):
    return f"CAST({x} AS DOUBLE)"


def div(a, b):
    return f"CASE WHEN ({b}) = 0 OR ({b}) IS NULL THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / ({b}) END"


DOCS = "SELECT doc_id AS id, text, source AS username, CAST(length(text) AS INTEGER) AS reply_length FROM documents"
COMMENTS = f"""SELECT d.id, d.text, d.username, e.ts AS timestamp, d.reply_length
FROM ({DOCS}) d LEFT JOIN events e ON e.event_id = d.id"""
TAGS = """SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END
AS manual_sentiment, 'yes' AS is_tagged FROM labels"""
JOINED = f"SELECT d.*, t.manual_sentiment, t.is_tagged FROM ({DOCS}) d LEFT JOIN ({TAGS}) t USING (id)"


def stand_in(factor, shift):
    return f"""SELECT id, CASE WHEN b % 10 < 5 THEN 'negative' WHEN b % 10 < 8 THEN 'positive' ELSE 'neutral' END
AS ml_sentiment, 0.35::DOUBLE + 0.65::DOUBLE * CAST(b AS DOUBLE) / 1000.0::DOUBLE AS ml_confidence
FROM (SELECT doc_id AS id, (doc_id * {factor} + {shift}) % 1000 AS b FROM documents)"""


PRED_A, PRED_B = stand_in(7919, 13), stand_in(104729, 7)
MERGED = f"""SELECT a.id, a.ml_sentiment AS sa, a.ml_confidence AS ca, b.ml_sentiment AS sb, b.ml_confidence AS cb,
t.manual_sentiment AS truth FROM ({PRED_A}) a JOIN ({PRED_B}) b USING (id) LEFT JOIN ({TAGS}) t USING (id)"""
PREDS = f"""SELECT p.*, t.manual_sentiment, CAST(length(d.text) AS INTEGER) AS text_length,
CASE ml_sentiment WHEN 'negative' THEN ml_confidence ELSE (1.0::DOUBLE - ml_confidence) * 0.75::DOUBLE END AS p_negative,
CASE ml_sentiment WHEN 'neutral' THEN ml_confidence WHEN 'negative' THEN (1.0::DOUBLE - ml_confidence) * 0.75::DOUBLE
ELSE (1.0::DOUBLE - ml_confidence) * 0.25::DOUBLE END AS p_neutral,
CASE ml_sentiment WHEN 'positive' THEN ml_confidence ELSE (1.0::DOUBLE - ml_confidence) * 0.25::DOUBLE END AS p_positive
FROM (SELECT 'roberta_social' AS model_name, 'neural_pretrained' AS model_type, * FROM ({PRED_A})
UNION ALL SELECT 'gradient_boosting', 'traditional', * FROM ({PRED_B})) p
LEFT JOIN ({TAGS}) t USING (id) JOIN documents d ON d.doc_id = p.id"""
EVALUABLE = f"SELECT * FROM ({PREDS}) WHERE ml_sentiment IS NOT NULL AND trim(manual_sentiment) <> ''"
MODEL_ORDER = "CASE model_name WHEN 'roberta_social' THEN 1 ELSE 2 END"

STRIP = f"^[{SPACE}]+|[{SPACE}]+$"


def strip(expr):
    return f"regexp_replace({expr}, '{STRIP}', '', 'g')"


def keyword_count(expr, words):
    return f"CAST(len(list_filter({sql_list(words)}, lambda k: contains(lower({expr}), k))) AS INTEGER)"


RUNS = f"regexp_extract_all(t, '{EMOJI}')"
CLEANED = strip(f"regexp_replace(t, '{EMOJI}', '', 'g')")
CAPS = (f"len(list_filter(string_split_regex(t, '[{SPACE}]+'), lambda w: length(w) > 2 AND "
        r"regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '[\p{Ll}\p{Lt}]'))) > 0")
TEXT_COLUMNS = {
    "cleaned_text": CLEANED,
    "emojis": f"array_to_string({RUNS}, '')",
    "emoji_count": f"CAST(len({RUNS}) AS INTEGER)",
    "has_question": "contains(t, '?')",
    "has_exclamation": "contains(t, '!')",
    "has_caps": CAPS,
    "word_count": f"CAST(len(regexp_extract_all({CLEANED}, '[^{SPACE}]+')) AS INTEGER)",
    "char_count": "CAST(length(t) AS INTEGER)",
    "positive_keywords": keyword_count("t", POSITIVE_KEYWORDS),
    "negative_keywords": keyword_count("t", NEGATIVE_KEYWORDS),
}
STRIPPED = f"SELECT *, {strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS t FROM"
FEATURES = ", ".join(f"{e} AS {c}" for c, e in TEXT_COLUMNS.items())
LEX_ROWS = sorted({(k, 1.0) for k in POSITIVE_KEYWORDS if " " not in k} | {(k, -1.0) for k in NEGATIVE_KEYWORDS})
LEXICON = "(VALUES " + ", ".join(f"({q(t)}, {v}::DOUBLE, 1.0::DOUBLE)" for t, v in LEX_ROWS) + \
    ") lex(term, valence, subjectivity)"

# Every comment with text features and lexicon scores.
SCORED = rf"""WITH base AS ({STRIPPED} ({COMMENTS})),
words AS (SELECT id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+') AS ws FROM base),
hits AS (SELECT id, sum(valence) AS total, sum(greatest(valence, 0)) AS pos, sum(greatest(-valence, 0)) AS neg,
sum(subjectivity) AS subj, count(*) AS hits FROM (SELECT id, unnest(ws) AS term FROM words) w JOIN {LEXICON} USING (term)
GROUP BY id),
full_hits AS (SELECT words.id, len(ws) AS n, coalesce(total, 0) AS total, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg,
coalesce(subj, 0) AS subj, coalesce(hits, 0) AS hits FROM words LEFT JOIN hits USING (id)),
scores AS (SELECT id, total / sqrt(total * total + 15.0) AS vader_compound,
{div('pos', 'pos + neg + n - hits')} AS vader_positive, {div('neg', 'pos + neg + n - hits')} AS vader_negative,
CASE WHEN pos + neg + n - hits = 0 THEN 1.0 ELSE (n - hits) / CAST(pos + neg + n - hits AS DOUBLE) END AS vader_neutral,
{div('total', 'hits')} AS textblob_polarity, {div('subj', 'hits')} AS textblob_subjectivity FROM full_hits),
feat AS (SELECT id, text, username, timestamp, reply_length, t <> '' AS has_text, {FEATURES} FROM base),
fused AS (SELECT feat.*, scores.* EXCLUDE (id), vader_compound * 0.6::DOUBLE + textblob_polarity * 0.4::DOUBLE
AS combined_sentiment_score FROM feat JOIN scores USING (id))"""
COMPOUND_LABEL = "CASE WHEN vader_compound >= 0.1 THEN 'positive' WHEN vader_compound <= -0.1 THEN 'negative' ELSE 'neutral' END"
POLARITY_LABEL = "CASE WHEN textblob_polarity > 0.1 THEN 'positive' WHEN textblob_polarity < -0.1 THEN 'negative' ELSE 'neutral' END"


def final(score):
    return f"""CASE WHEN {score} > 0.05 THEN 'positive' WHEN {score} < -0.05 THEN 'negative'
WHEN abs({score}) > 0.02 THEN CASE WHEN positive_keywords > negative_keywords THEN 'positive'
WHEN negative_keywords > positive_keywords THEN 'negative' WHEN emoji_count > 0 AND {score} > 0 THEN 'positive'
ELSE 'neutral' END ELSE 'neutral' END"""


FINAL = final("combined_sentiment_score")
BAND = """CASE WHEN abs(combined_sentiment_score) > 0.3 THEN 'high' WHEN abs(combined_sentiment_score) > 0.1 THEN 'medium'
ELSE 'low' END"""
ANALYZED = f"""{SCORED}, analyzed AS (SELECT *, {COMPOUND_LABEL} AS vader_sentiment, {POLARITY_LABEL} AS textblob_sentiment,
{FINAL} AS final_sentiment, {BAND} AS confidence, FALSE AS is_nested, CAST(hour(timestamp) AS INTEGER) AS hour FROM fused)"""
SCORE_COLS = ("vader_compound", "vader_positive", "vader_negative", "vader_neutral", "textblob_polarity",
              "textblob_subjectivity", "combined_sentiment_score")
ROUNDED = ", ".join(f"{r(c)} AS {c}" for c in SCORE_COLS)


def normalize(c):
    s = f"lower(trim({c}))"
    return f"""CASE WHEN {s} = '' THEN NULL WHEN {s} IN ('pos','+','positive') THEN 'positive'
WHEN {s} IN ('neg','-','negative') THEN 'negative' WHEN {s} IN ('neu','neutral','0') THEN 'neutral' ELSE {s} END"""


def share(source, label, out="label"):
    return f"""SELECT {label} AS {out}, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS percent
FROM {source} WHERE {label} IS NOT NULL GROUP BY 1"""


def naive_bayes(prepared, terms, grams, folds, alpha=0.5, least=2, share=0.95, most=10_000):
    """Labels of the multinomial model trained on the training rows' TF-IDF, as the table `best`: of all comments by one model,
    or of the training rows by the model of the other folds."""
    x = terms.replace("lower(text)", f"lower({prepared})")
    fold = f"CAST({FOLD} AS INTEGER)" if folds else "0"
    return f"""WITH s AS (SELECT id, manual_sentiment, {IS_TEST} AS is_test FROM ({SPLIT})),
lab0 AS (SELECT id, manual_sentiment FROM s WHERE NOT is_test),
lab AS (SELECT id, manual_sentiment, {fold} AS fold FROM ({SPLIT.replace(f'({TAGS})', 'lab0') if folds else 'lab0'})),
g AS (SELECT id, unnest(g) AS term FROM (SELECT id, {grams} AS g FROM (SELECT id, {x} AS x FROM ({DOCS})))),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM lab),
v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf JOIN lab USING (id) GROUP BY 1 HAVING count(*) >= {least}
AND count(*) <= {share} * (SELECT n FROM n) ORDER BY cf DESC, term LIMIT {most}),
w AS (SELECT id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM tf JOIN v USING (term)),
f AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x FROM w),
models AS (SELECT DISTINCT {'fold' if folds else '0 AS fold'} FROM lab),
used AS (SELECT m.fold, lab.id, manual_sentiment AS class FROM models m, lab {'WHERE lab.fold <> m.fold' if folds else ''}),
prior AS (SELECT fold, class, ln(count(*)) - ln(sum(count(*)) OVER (PARTITION BY fold)) AS prior FROM used GROUP BY 1, 2),
sums AS (SELECT fold, class, term, sum(x) AS x FROM used JOIN f USING (id) GROUP BY 1, 2, 3),
mass AS (SELECT fold, class, ln(sum(x) + {alpha}::DOUBLE * (SELECT count(*) FROM v)) AS mass FROM sums GROUP BY 1, 2),
theta AS (SELECT fold, class, v.term, ln(coalesce(sums.x, 0) + {alpha}::DOUBLE) - mass AS theta FROM mass CROSS JOIN v
LEFT JOIN sums USING (fold, class, term)),
asked AS (SELECT d.doc_id AS id, {'lab.fold, lab.manual_sentiment' if folds else '0 AS fold, NULL AS manual_sentiment'}
FROM documents d {'JOIN lab ON lab.id = d.doc_id' if folds else ''}),
logs AS (SELECT a.id, a.fold, a.manual_sentiment, p.class, p.prior + coalesce(sum(f.x * theta.theta), 0) AS l
FROM asked a JOIN prior p USING (fold) LEFT JOIN f ON f.id = a.id LEFT JOIN theta ON theta.fold = a.fold AND theta.class = p.class
AND theta.term = f.term GROUP BY a.id, a.fold, a.manual_sentiment, p.class, p.prior),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM logs),
best AS (SELECT id, fold, manual_sentiment, arg_max(class, e) AS ml_sentiment, max(e) / sum(e) AS ml_confidence FROM e GROUP BY 1, 2, 3)"""


def summary(source, cols):
    """Metrics per model over a table with model_name, manual_sentiment, ml_sentiment."""
    return f"""WITH p AS ({source}),
sides AS (SELECT model_name, manual_sentiment AS label, 1 AS support, 0 AS predicted,
CASE WHEN manual_sentiment = ml_sentiment THEN 1 ELSE 0 END AS tp FROM p
UNION ALL SELECT model_name, ml_sentiment, 0, 1, 0 FROM p),
per AS (SELECT model_name, label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM sides GROUP BY 1, 2),
pr AS (SELECT *, {div('tp', 'predicted')} AS precision, {div('tp', 'support')} AS recall FROM per),
cls AS (SELECT *, {div('2 * precision * recall', 'precision + recall')} AS f1 FROM pr),
summ AS (SELECT model_name, CAST(sum(support) AS BIGINT) AS support, {div('sum(tp)', 'sum(support)')} AS accuracy,
avg(precision) AS precision_macro, {div('sum(precision * support)', 'sum(support)')} AS precision_weighted,
avg(recall) AS recall_macro, {div('sum(recall * support)', 'sum(support)')} AS recall_weighted,
avg(f1) AS f1_macro, {div('sum(f1 * support)', 'sum(support)')} AS f1_weighted FROM cls GROUP BY 1)
{cols}"""


METRIC_COLS = ("accuracy", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted", "f1_macro",
               "f1_weighted")
SUMMARY_OUT = "SELECT model_name, support, " + ", ".join(f"{r(c)} AS {c}" for c in METRIC_COLS) + " FROM summ"


def normalized(source):
    """Accuracy over all normalised labels and weighted F1 over the known three, as CTE `nm`."""
    known = in_list(LABELS)
    return f"""WITH p0 AS ({source}), p1 AS (SELECT model_name, {normalize('manual_sentiment')} AS manual_sentiment,
{normalize('ml_sentiment')} AS ml_sentiment FROM p0),
acc AS (SELECT model_name, count(*) AS rows,
{div('count_if(manual_sentiment = ml_sentiment)', 'count_if(manual_sentiment IS NOT NULL AND ml_sentiment IS NOT NULL)')}
AS accuracy FROM p1 GROUP BY 1),
f AS ({summary(f"SELECT * FROM p1 WHERE manual_sentiment IN {known} AND ml_sentiment IN {known}",
               "SELECT model_name, f1_weighted FROM summ")}),
nm AS (SELECT acc.model_name, rows, accuracy, coalesce(f1_weighted, 0) AS weighted_f1 FROM acc LEFT JOIN f USING (model_name))"""


# Ensemble rules over a merged row (sa, ca, sb, cb).
W = WB / (WA + WB)
VOTE = "CASE WHEN sa = sb THEN sa WHEN ca > cb THEN sa ELSE sb END"
WEIGHTED = f"ca * ({WA}::DOUBLE / ({WA}::DOUBLE + {WB}::DOUBLE)) > cb * ({WB}::DOUBLE / ({WA}::DOUBLE + {WB}::DOUBLE))"
RULES = {
    "majority_vote": VOTE,
    "weighted_average": f"CASE WHEN {WEIGHTED} THEN sa ELSE sb END",
    "confidence_weighted": "CASE WHEN ca > cb THEN sa ELSE sb END",
    "stacked": "CASE WHEN sa = sb THEN sa WHEN abs(ca - cb) > 0.3 THEN CASE WHEN ca > cb THEN sa ELSE sb END ELSE sb END",
    "adaptive": f"""CASE WHEN (ca + cb) / 2 > 0.8 THEN {VOTE} WHEN (ca + cb) / 2 > 0.5 THEN sb
WHEN cb * {W!r}::DOUBLE > ca * (1 - {W!r}::DOUBLE) THEN sb ELSE sa END""",
}
ENSEMBLED = f"SELECT *, {', '.join(f'{e} AS e_{m}' for m, e in RULES.items())} FROM ({MERGED})"
ENSEMBLE_LONG = " UNION ALL ".join(
    f"SELECT {q(m)} AS model_name, e_{m} AS ml_sentiment, truth AS manual_sentiment, id FROM ens" for m in RULES)
BASE_LONG = """ UNION ALL SELECT 'roberta_base', sa, truth, id FROM ens
UNION ALL SELECT 'gradient_boosting_base', sb, truth, id FROM ens"""
METHOD_ORDER = [*RULES, "roberta_base", "gradient_boosting_base"]

PRED_RENAMED = """sa AS ml_sentiment_roberta, ca AS ml_confidence_roberta, sb AS ml_sentiment_gb,
cb AS ml_confidence_gb"""
PRED_ROUNDED = f"sa AS ml_sentiment_roberta, {r('ca')} AS ml_confidence_roberta, sb AS ml_sentiment_gb, {r('cb')} AS ml_confidence_gb"


def hashed(seed=42):
    return f"md5(CAST(id AS VARCHAR) || ':{seed}')"


SPLIT = f"""SELECT id, manual_sentiment, row_number() OVER (PARTITION BY manual_sentiment ORDER BY {hashed()}) AS rn,
count(*) OVER (PARTITION BY manual_sentiment) AS n FROM ({TAGS})"""
IS_TEST = "rn <= round(n * 0.2::DOUBLE)"
FOLD = " + ".join(f"CASE WHEN rn > round(n * {i / 5!r}::DOUBLE) THEN 1 ELSE 0 END" for i in range(1, 5))


def oracle_sql():
    o = {}
    text_only = f"({STRIPPED} ({DOCS}))"

    # Sources
    o["read_comments"] = f"""SELECT id, CASE WHEN text IN {in_list(NA_TOKENS)} THEN NULL ELSE text END AS text,
username, timestamp, reply_length FROM ({COMMENTS})"""
    o["flatten_reply_pages"] = """SELECT conv_id * 100 + turn AS id, text, role AS username, CAST(NULL AS VARCHAR) AS timestamp,
CAST(NULL AS VARCHAR) AS permalink, CAST(NULL AS INTEGER) AS reply_count FROM conversations"""
    o["training_gate"] = f"""SELECT n AS tagged_rows, CASE WHEN n < 10 THEN 'stop' WHEN n < 20 THEN 'warn'
WHEN n < 50 THEN 'train' ELSE 'fine_tune' END AS status FROM (SELECT count(*) AS n FROM ({TAGS}) WHERE manual_sentiment <> '')"""
    o["read_existing_tags"] = f"""SELECT id, CASE WHEN tag IN {in_list(LABELS)} THEN tag END AS existing_tag FROM
(SELECT id, text, lower(coalesce(nullif(CASE WHEN username = 'src3' THEN upper(manual_sentiment) WHEN username = 'src4' THEN 'Mixed'
ELSE '' END, ''), nullif(manual_sentiment, ''))) AS tag FROM ({JOINED})) WHERE {strip('text')} <> ''"""

    # Sinks that keep rows
    o["export_tagged"] = f"""SELECT id, text, username, reply_length, coalesce(manual_sentiment, '') AS manual_sentiment,
CASE WHEN manual_sentiment IS NULL THEN 'no' ELSE 'yes' END AS is_tagged FROM ({JOINED})"""
    o["write_table"] = f"SELECT id, text, username, timestamp, reply_length FROM ({COMMENTS})"
    o["write_per_model"] = f"""SELECT id, model_type, ml_sentiment, {r('ml_confidence', 9)} AS ml_confidence, manual_sentiment,
text_length, {r('p_positive', 9)} AS ml_prob_positive, {r('p_negative', 9)} AS ml_prob_negative,
{r('p_neutral', 9)} AS ml_prob_neutral, model_name AS algorithm_name, model_name FROM ({PREDS})"""

    # Projections
    base = f"({JOINED})"
    o["fill_defaults"] = f"SELECT id, coalesce(text, '') AS text, username, coalesce(CASE WHEN username = 'src1' THEN NULL ELSE reply_length END, 0) AS word_count FROM {base}"
    o["coerce_booleans"] = f"SELECT id, coalesce(lower(is_tagged) IN ('true', '1', 'yes'), FALSE) AS is_nested, TRUE AS has_text FROM {base}"
    o["coerce_numeric"] = f"SELECT id, coalesce(TRY_CAST(username AS DOUBLE), 0) AS username, coalesce(TRY_CAST(regexp_replace(username, 'src', '') AS DOUBLE), 0) AS word_count FROM {base}"
    o["tagged_only"] = f"SELECT id, username, manual_sentiment FROM {base} WHERE manual_sentiment IS NOT NULL AND manual_sentiment <> ''"
    o["untagged_only"] = f"SELECT id, username, manual_sentiment FROM {base} WHERE manual_sentiment IS NULL OR manual_sentiment = ''"
    o["add_length_flags"] = f"SELECT id, reply_length, {strip('text')} <> '' AS has_text FROM ({DOCS})"
    o["select_available"] = f"SELECT id, text, username, timestamp, reply_length FROM ({COMMENTS})"
    short = """SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'NEG' WHEN quality = 1 THEN '+' WHEN quality = 0 THEN '0'
ELSE upper(lang) END AS label FROM documents LEFT JOIN labels USING (doc_id)"""
    o["normalize_label"] = f"SELECT id, label, {normalize('label')} AS normalized FROM ({short})"
    o["preview"] = f"SELECT id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview FROM ({DOCS})"
    o["to_long"] = f"SELECT id, model_name, CAST(NULL AS VARCHAR) AS model_type, ml_sentiment, {r('ml_confidence')} AS ml_confidence FROM ({PREDS})"
    o["to_wide"] = f"""SELECT id, sa AS roberta_social_sentiment, {r('ca')} AS roberta_social_confidence,
sb AS gradient_boosting_sentiment, {r('cb')} AS gradient_boosting_confidence FROM ({MERGED})"""
    o["attach_metadata"] = summary(EVALUABLE, f"""SELECT p.id, p.model_name, p.ml_sentiment, {r('summ.accuracy')} AS accuracy,
{r('summ.f1_weighted')} AS f1_weighted, CASE WHEN contains(p.model_name, 'gradient') THEN 'ensemble' ELSE 'linear' END
AS model_family, TIMESTAMP '2025-01-01 00:00:00' AS run_ts FROM ({PREDS}) p LEFT JOIN summ USING (model_name)""")
    o["mark_mismatch"] = f"SELECT id, model_name, ml_sentiment, manual_sentiment, coalesce(ml_sentiment <> manual_sentiment, FALSE) AS mismatch FROM ({PREDS})"
    o["filter_model"] = f"SELECT id, model_name, ml_sentiment FROM ({PREDS}) WHERE model_name = 'gradient_boosting' OR model_type = 'gradient_boosting'"
    o["algorithm_names"] = f"SELECT DISTINCT coalesce(nullif(model_type, ''), model_name) AS algorithm FROM ({PREDS})"
    o["stack_predictions"] = f"SELECT id, model_name, ml_sentiment, {r('ml_confidence')} AS ml_confidence FROM ({PREDS})"

    # Text
    for name in ("emojis", "emoji_count", "cleaned_text", "has_question", "has_exclamation", "has_caps", "word_count",
                 "char_count"):
        key = {"emojis": "extract_emojis", "emoji_count": "count_emoji_runs", "cleaned_text": "strip_emojis"}.get(name, name)
        o[key] = f"SELECT id, {TEXT_COLUMNS[name]} AS {name} FROM {text_only}"
    o["count_keywords"] = f"SELECT id, {TEXT_COLUMNS['positive_keywords']} AS positive_keywords, {TEXT_COLUMNS['negative_keywords']} AS negative_keywords FROM {text_only}"
    o["text_features"] = f"SELECT id, {FEATURES} FROM {text_only}"
    collapse = "trim(regexp_replace({}, '[{}]+', ' ', 'g'))"
    o["preprocess_letters"] = f"SELECT id, {collapse.format(f'regexp_replace(lower(text), {q(f'[^a-zA-Z{SPACE}]')}, {q(' ')}, {q('g')})', SPACE)} AS processed FROM ({DOCS})"
    no_url = f"regexp_replace(lower(text), 'http[^{SPACE}]+|www[^{SPACE}]+|https[^{SPACE}]+', '', 'g')"
    no_tag = f"regexp_replace({no_url}, '[@#][^{SPACE}]+', '', 'g')"
    o["preprocess_social"] = f"SELECT id, {collapse.format(f'regexp_replace({no_tag}, {q(f'[^a-zA-Z{SPACE}!?.,]')}, {q(' ')}, {q('g')})', SPACE)} AS processed FROM ({DOCS})"
    keep = rf"[^\p{{L}}\p{{N}}_{SPACE}!?.,@#$%]"
    o["preprocess_punct"] = f"SELECT id, {collapse.format(f'regexp_replace(lower(text), {q(keep)}, {q(' ')}, {q('g')})', SPACE)} AS processed FROM ({DOCS})"
    tokens = rf"""list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), 'https?://[^{SPACE}]+', ' ', 'g'),
'[^a-z0-9{SPACE}\x27]', ' ', 'g'), '[{SPACE}]+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(REPORT_STOP_WORDS)}, w))"""
    o["tokenize_words"] = f"SELECT id, CAST(len(x) AS INTEGER) AS n_tokens, array_to_string(x, ' ') AS tokens FROM (SELECT id, {tokens} AS x FROM ({DOCS}))"
    stop = sql_list(english_stop_words())
    terms = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({stop}, w))"
    grams = f"list_concat(x, list_transform(range(1, greatest(len(x), 1)), lambda i: x[i] || ' ' || x[i + 1]))"
    o["tokenize_ngrams"] = f"SELECT id, CAST(len(g) AS INTEGER) AS n_tokens, array_to_string(g, '|') AS tokens FROM (SELECT id, {grams} AS g FROM (SELECT id, {terms} AS x FROM ({DOCS})))"

    # Sentiment
    o["lexicon_score"] = f"{SCORED} SELECT id, {', '.join(f'{r(c)} AS {c}' for c in SCORE_COLS[:-1])} FROM fused"
    o["lexicon_score_joined"] = o["lexicon_score_dictionary"] = o["lexicon_score"]
    o["classify_compound"] = f"{ANALYZED} SELECT id, vader_sentiment FROM analyzed"
    o["classify_polarity"] = f"{ANALYZED} SELECT id, textblob_sentiment FROM analyzed"
    o["combined_score"] = f"{ANALYZED} SELECT id, {r('combined_sentiment_score')} AS combined_sentiment_score FROM analyzed"
    o["final_sentiment"] = f"{ANALYZED} SELECT id, final_sentiment FROM analyzed"
    o["confidence_band"] = f"{ANALYZED} SELECT id, confidence FROM analyzed"
    o["analyze_comments"] = f"{ANALYZED} SELECT * REPLACE ({ROUNDED}) FROM analyzed"
    o["reanalyze"] = f"""{ANALYZED} SELECT id, final_sentiment, {r('vader_compound')} AS vader_compound_fixed,
{r('textblob_polarity')} AS textblob_polarity_fixed, {r('combined_sentiment_score')} AS combined_score_fixed,
positive_keywords AS positive_keywords_fixed, negative_keywords AS negative_keywords_fixed,
emoji_count AS emoji_count_fixed, final_sentiment AS final_sentiment_fixed, confidence AS confidence_fixed FROM analyzed"""
    o["compare_with_original"] = f"""{ANALYZED} SELECT label, CAST(sum(o) AS BIGINT) AS original, CAST(sum(f) AS BIGINT) AS fixed FROM (
SELECT textblob_sentiment AS label, 1 AS o, 0 AS f FROM analyzed UNION ALL SELECT final_sentiment, 0, 1 FROM analyzed) GROUP BY 1"""
    o["map_model_labels"] = f"""SELECT id, CASE WHEN p_negative >= p_neutral AND p_negative >= p_positive THEN 'negative'
WHEN p_neutral >= p_positive THEN 'neutral' ELSE 'positive' END AS sentiment, {r('greatest(p_negative, p_neutral, p_positive)')}
AS confidence FROM ({PREDS}) WHERE model_name = 'roberta_social'"""
    o["map_binary_labels"] = f"""SELECT id, CASE WHEN abs(pos - neg) < 0.15 THEN 'neutral' WHEN pos > neg THEN 'positive'
ELSE 'negative' END AS sentiment, {r('CASE WHEN abs(pos - neg) < 0.15 THEN 0.5 ELSE greatest(pos, neg) END')} AS confidence
FROM (SELECT id, ml_confidence AS neg, 1.0::DOUBLE - ml_confidence AS pos FROM ({PRED_A}))"""

    # Time
    o["parse_timestamp"] = f"SELECT event_id AS id, ts AS parsed FROM events"
    o["time_features"] = """SELECT event_id AS id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend FROM events"""

    # Joins
    o["merge_tags"] = f"SELECT id, text, username, reply_length, manual_sentiment, is_tagged FROM ({JOINED})"
    o["ids_only_in_tags"] = "SELECT doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT conv_id * 100 + turn FROM conversations)"
    o["ids_only_in_comments"] = "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    o["merge_model_outputs"] = f"SELECT id, {PRED_ROUNDED} FROM ({MERGED})"
    o["merge_by_order"] = f"""SELECT a.position, a.id AS id_roberta, b.id AS id_gb, a.ml_sentiment AS ml_sentiment_roberta,
b.ml_sentiment AS ml_sentiment_gb, {r('a.ml_confidence')} AS ml_confidence_roberta, {r('b.ml_confidence')} AS ml_confidence_gb
FROM (SELECT *, row_number() OVER (ORDER BY ml_confidence, id) AS position FROM ({PRED_A})) a
JOIN (SELECT *, row_number() OVER (ORDER BY ml_confidence, id) AS position FROM ({PRED_B})) b USING (position)"""

    # Aggregations
    o["label_distribution"] = f"{ANALYZED} {share('analyzed', 'final_sentiment')}"
    o["confidence_distribution"] = f"{ANALYZED} {share('analyzed', 'confidence', 'confidence')}"
    o["distribution_3"] = f"""SELECT label, count(ml_sentiment) AS n,
round(count(ml_sentiment) * 100.0::DOUBLE / (SELECT count(*) FROM ({PRED_A})), 1) AS percent
FROM (VALUES ('positive'), ('neutral'), ('negative')) l(label) LEFT JOIN ({PRED_A}) ON ml_sentiment = label GROUP BY 1"""
    stats = """count(combined_sentiment_score) AS count, {} AS mean, {} AS std, {} AS min, {} AS q25, {} AS q50, {} AS q75,
{} AS max""".format(*[r(e) for e in (
        "avg(combined_sentiment_score)", "stddev_samp(combined_sentiment_score)", "min(combined_sentiment_score)",
        "quantile_cont(combined_sentiment_score, 0.25)", "quantile_cont(combined_sentiment_score, 0.5)",
        "quantile_cont(combined_sentiment_score, 0.75)", "max(combined_sentiment_score)")])
    o["score_statistics"] = f"{ANALYZED} SELECT {stats} FROM analyzed"
    report = ", ".join(f"count_if(final_sentiment = '{x}') AS {x}, {r(f'count_if(final_sentiment = {q(x)}) * 100.0 / count(*)')} AS {x}_percentage"
                       for x in LABELS)
    bands = ", ".join(f"count_if(confidence = '{x}') AS {x}" for x in ("high", "medium", "low"))
    o["analysis_report"] = f"{ANALYZED} SELECT count(*) AS total_replies, {report}, {bands}, {stats} FROM analyzed"
    o["reply_statistics"] = f"""SELECT count(*) AS total_replies, count(DISTINCT username) AS unique_users,
{r('avg(reply_length)')} AS average_length, max(reply_length) AS longest, min(reply_length) AS shortest FROM ({DOCS})"""
    o["tag_progress"] = f"""SELECT count(*) AS total, count(manual_sentiment) AS tagged, count(*) - count(manual_sentiment) AS remaining,
{r('count(manual_sentiment) * 100.0 / count(*)')} AS percent FROM {base}"""
    o["validate_merged"] = f"""WITH m AS (SELECT *, coalesce(text = '', TRUE) AS empty, coalesce(manual_sentiment <> '', FALSE) AS tagged
FROM {base})
SELECT 'duplicate_ids' AS "check", CAST(NULL AS VARCHAR) AS item, {dbl('count(*) - count(DISTINCT id)')} AS value FROM m
UNION ALL SELECT 'empty_text', NULL, {dbl('count_if(empty)')} FROM m
UNION ALL SELECT 'tagged_with_empty_text', NULL, {dbl('count_if(empty AND tagged)')} FROM m
UNION ALL SELECT 'mean_length', NULL, {r('avg(length(text))')} FROM m
UNION ALL SELECT 'min_length', NULL, {dbl('min(length(text))')} FROM m
UNION ALL SELECT 'max_length', NULL, {dbl('max(length(text))')} FROM m
UNION ALL SELECT CASE WHEN manual_sentiment IN {in_list(LABELS)} THEN 'label' ELSE 'unusual_label' END, manual_sentiment,
{dbl('count(*)')} FROM m WHERE tagged GROUP BY 1, 2"""
    o["merge_summary"] = f"SELECT count(*) AS total_rows, count(manual_sentiment) AS with_tags, count(*) - count(manual_sentiment) AS without_tags FROM {base}"
    o["data_quality_summary"] = f"""SELECT model_name, count(*) AS total_samples, count_if(text_length > 0) AS samples_with_text,
count(manual_sentiment) AS samples_with_manual_tags, {r('avg(text_length)')} AS average_text_length,
count_if(ml_sentiment IS NULL) AS missing_predictions FROM ({PREDS}) GROUP BY 1"""
    o["prediction_distribution"] = f"""SELECT model_name, label, count_if(ml_sentiment = label) AS n,
{r('count_if(ml_sentiment = label) * 100.0 / count(*)')} AS percent
FROM ({PREDS}), (VALUES ('positive'), ('neutral'), ('negative')) l(label) GROUP BY 1, 2"""
    o["confidence_stats"] = f"""SELECT model_name, {r('avg(ml_confidence)')} AS mean, {r('stddev_samp(ml_confidence)')} AS std,
{r('min(ml_confidence)')} AS min, {r('max(ml_confidence)')} AS max, count_if(ml_confidence > 0.8) AS high_confidence,
{r('count_if(ml_confidence > 0.8) * 100.0 / count(*)')} AS high_confidence_percent FROM ({PREDS}) GROUP BY 1"""
    dist = ", ".join(f"{r(f'count_if({c} = {q(x)}) * 100.0 / count({c})')} AS {x}_percent{s}"
                     for c, s in (("sa", "_roberta"), ("sb", "_gb")) for x in LABELS)
    o["model_agreement"] = f"""SELECT count(*) AS total, count_if(sa = sb) AS agreeing, {r('count_if(sa = sb) * 100.0 / count(*)')}
AS agreement_percent, {r('avg(ca)')} AS average_confidence_roberta, {r('avg(cb)')} AS average_confidence_gb, {dist} FROM ({MERGED})"""
    o["agreement_matrix"] = f"""WITH ens AS ({ENSEMBLED}), long AS ({ENSEMBLE_LONG} {BASE_LONG})
SELECT a.model_name AS method1, b.model_name AS method2, {r('avg(CASE WHEN a.ml_sentiment = b.ml_sentiment THEN 1.0 ELSE 0.0 END)')}
AS agreement FROM long a JOIN long b USING (id) WHERE a.ml_sentiment IS NOT NULL AND b.ml_sentiment IS NOT NULL GROUP BY 1, 2"""
    o["term_frequency"] = f"SELECT word, count(*) AS n FROM (SELECT unnest({tokens}) AS word FROM ({DOCS})) GROUP BY 1 ORDER BY n DESC, word LIMIT 50"
    o["term_frequency_negative"] = f"""SELECT word, count(*) AS n FROM (SELECT unnest({tokens}) AS word FROM ({DOCS}) JOIN ({PRED_A}) USING (id)
WHERE ml_sentiment = 'negative') GROUP BY 1 ORDER BY n DESC, word LIMIT 50"""
    o["training_accuracy"] = f"""SELECT count(*) AS tagged, count_if(sb = truth) AS correct, {r('count_if(sb = truth) / count(*)')} AS accuracy
FROM ({MERGED}) WHERE truth IS NOT NULL"""

    # Metrics
    seen = f"SELECT DISTINCT model_name, unnest([manual_sentiment, ml_sentiment]) AS label FROM p"
    o["confusion_matrix"] = f"""WITH p AS ({EVALUABLE}), seen AS ({seen})
SELECT t.model_name, t.label AS truth, s.label AS pred, count(p.id) AS n FROM seen t JOIN seen s USING (model_name)
LEFT JOIN p ON p.model_name = t.model_name AND p.manual_sentiment = t.label AND p.ml_sentiment = s.label GROUP BY 1, 2, 3"""
    o["dashboard_confusion"] = o["confusion_matrix"]
    o["class_metrics"] = summary(EVALUABLE, f"""SELECT model_name, label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT)
AS predicted, CAST(tp AS BIGINT) AS tp, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM cls""")
    o["summary_metrics"] = summary(EVALUABLE, SUMMARY_OUT)
    o["evaluate_pretrained"] = o["summary_metrics"]
    o["weighted_f1_3"] = f"{normalized(PREDS)} SELECT model_name, {r('weighted_f1')} AS weighted_f1 FROM nm"
    o["accuracy_normalized"] = f"{normalized(PREDS)} SELECT model_name, {r('accuracy')} AS accuracy FROM nm"
    o["auc_ovr_weighted"] = f"""WITH p AS ({EVALUABLE}),
s AS (SELECT model_name, manual_sentiment = 'negative' AS y, 'negative' AS class, p_negative AS score FROM p
UNION ALL SELECT model_name, manual_sentiment = 'neutral', 'neutral', p_neutral FROM p
UNION ALL SELECT model_name, manual_sentiment = 'positive', 'positive', p_positive FROM p),
d AS (SELECT model_name, class, score, count_if(y) AS np, count_if(NOT y) AS nn FROM s GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(sum(nn) OVER (PARTITION BY model_name, class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING), 0) AS below FROM d),
a AS (SELECT model_name, class, sum(np * (below + nn / 2)) / (sum(np) * sum(nn)) AS auc, sum(np) AS n FROM b GROUP BY 1, 2)
SELECT model_name, {r('sum(auc * n) / sum(n)')} AS auc FROM a GROUP BY 1"""
    folds = f"""WITH f AS (SELECT id, CAST({FOLD} AS INTEGER) AS fold FROM ({SPLIT})),
s AS (SELECT model_name, fold, avg(CASE WHEN ml_sentiment = manual_sentiment THEN 1.0 ELSE 0.0 END) AS score
FROM ({PREDS}) JOIN f USING (id) GROUP BY 1, 2)"""
    o["fold_accuracy"] = f"{folds} SELECT model_name, fold, {r('score')} AS score FROM s"
    o["cv_summary"] = f"{folds} SELECT model_name, {r('avg(score)')} AS cv_mean, {r('stddev_pop(score)')} AS cv_std, count(*) AS folds FROM s GROUP BY 1"

    # Ensembles
    for m, e in RULES.items():
        o[m] = f"SELECT id, {e} AS sentiment FROM ({MERGED})"
    share_a, share_b = f"({WA}::DOUBLE / ({WA}::DOUBLE + {WB}::DOUBLE))", f"({WB}::DOUBLE / ({WA}::DOUBLE + {WB}::DOUBLE))"
    o["weighted_average"] = f"""SELECT id, {RULES['weighted_average']} AS sentiment,
{r(f'CASE WHEN {WEIGHTED} THEN ca * {share_a} ELSE cb * {share_b} END')} AS confidence FROM ({MERGED})"""
    o["confidence_weighted"] = f"SELECT id, {RULES['confidence_weighted']} AS sentiment, {r('greatest(ca, cb)')} AS confidence FROM ({MERGED})"
    ens_cols = ", ".join(f"e_{m} AS ensemble_{m}" for m in RULES)
    o["run_ensembles"] = f"SELECT id, {PRED_ROUNDED}, truth AS manual_sentiment, {ens_cols} FROM ({ENSEMBLED})"
    o["write_ensemble"] = o["run_ensembles"]
    ens_eval = f"SELECT * FROM (WITH ens AS ({ENSEMBLED}) {ENSEMBLE_LONG}) WHERE manual_sentiment IS NOT NULL"
    o["evaluate_ensembles"] = summary(ens_eval, f"""SELECT model_name AS method, {r('accuracy')} AS accuracy,
{r('precision_macro')} AS precision_macro, {r('recall_macro')} AS recall_macro, {r('f1_macro')} AS f1_macro,
{r('f1_weighted')} AS f1_weighted, support AS valid_samples FROM summ""")
    order = "CASE model_name " + " ".join(f"WHEN {q(m)} THEN {i}" for i, m in enumerate(METHOD_ORDER)) + " END"
    o["method_comparison"] = f"""{normalized(f'SELECT * FROM (WITH ens AS ({ENSEMBLED}) {ENSEMBLE_LONG} {BASE_LONG})')}
SELECT model_name AS method, model_name NOT LIKE '%_base' AS is_ensemble, {r('accuracy')} AS accuracy, {r('weighted_f1')} AS weighted_f1,
rows AS total_samples, CAST(rank AS INTEGER) AS rank, rank = 1 AS is_best
FROM (SELECT *, row_number() OVER (ORDER BY round(weighted_f1, 12) DESC, {order}) AS rank FROM nm)"""

    # Rankings and samples
    o["sample_per_class"] = f"""SELECT id, username, manual_sentiment, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number()
OVER (PARTITION BY manual_sentiment ORDER BY id) AS rank FROM {base} WHERE manual_sentiment IS NOT NULL) WHERE rank <= 3"""
    ranks = " UNION ALL ".join(f"SELECT '{m}' AS metric, model_name, {m} AS value FROM summ" for m in ("f1_weighted", "accuracy", "f1_macro"))
    o["rank_models"] = summary(EVALUABLE, f"""SELECT metric, model_name, {r('value')} AS value,
CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, {MODEL_ORDER}) AS INTEGER) AS rank FROM ({ranks})""")
    o["pick_winner"] = summary(EVALUABLE, f"SELECT model_name, {r('accuracy')} AS accuracy FROM summ ORDER BY summ.accuracy DESC, {MODEL_ORDER} LIMIT 1")
    o["winner_columns"] = summary(EVALUABLE, f"""SELECT id, ml_sentiment, {r('ml_confidence', 9)} AS ml_confidence, model_name AS model_type,
{r('p_positive', 9)} AS ml_prob_positive, {r('p_negative', 9)} AS ml_prob_negative, {r('p_neutral', 9)} AS ml_prob_neutral
FROM ({PREDS}) WHERE model_name = (SELECT model_name FROM summ ORDER BY accuracy DESC, {MODEL_ORDER} LIMIT 1)""")
    acc = f"""SELECT model_name, avg(CASE WHEN NOT t THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END) AS train_accuracy,
avg(CASE WHEN t THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END) AS test_accuracy FROM (SELECT model_name,
ml_sentiment = p.manual_sentiment AS hit, {IS_TEST} AS t FROM ({PREDS}) p JOIN ({SPLIT}) s USING (id)) GROUP BY 1"""
    o["split_accuracy"] = f"SELECT model_name, {r('train_accuracy')} AS train_accuracy, {r('test_accuracy')} AS test_accuracy FROM ({acc})"
    o["model_gap"] = f"""SELECT {r('a.test_accuracy')} AS test_a, {r('b.test_accuracy')} AS test_b,
{r('abs(a.test_accuracy - b.test_accuracy)')} AS gap, CASE WHEN abs(a.test_accuracy - b.test_accuracy) < 0.02 THEN 'similar'
WHEN abs(a.test_accuracy - b.test_accuracy) < 0.05 THEN 'small' ELSE 'significant' END AS band,
a.train_accuracy - a.test_accuracy > 0.1 AS overfit_a, b.train_accuracy - b.test_accuracy > 0.1 AS overfit_b
FROM ({acc}) a, ({acc}) b WHERE a.model_name = 'gradient_boosting' AND b.model_name = 'roberta_social'"""
    rec = summary(EVALUABLE, f"""SELECT *, row_number() OVER (ORDER BY f1_weighted DESC, {MODEL_ORDER}) AS rank,
model_name = 'gradient_boosting' AS trad FROM summ""")
    score = "printf(' (F1: %.3f)', f1_weighted)"
    o["recommendations"] = f"""WITH m AS ({rec})
SELECT 'best_overall' AS kind, model_name AS models, 'Best overall model: ' || model_name || {score} AS recommendation FROM m WHERE rank = 1
UNION ALL SELECT 'best_traditional', model_name, 'Best traditional model: ' || model_name || {score} FROM m WHERE trad
UNION ALL SELECT 'best_neural', model_name, 'Best neural model: ' || model_name || {score} FROM m WHERE NOT trad
UNION ALL SELECT * FROM (SELECT 'excellent', string_agg(model_name, ', ' ORDER BY {MODEL_ORDER}) AS s,
'Models with excellent performance (F1>0.85): ' || string_agg(model_name, ', ' ORDER BY {MODEL_ORDER}) FROM m WHERE f1_weighted > 0.85) WHERE s IS NOT NULL
UNION ALL SELECT * FROM (SELECT 'good', string_agg(model_name, ', ' ORDER BY {MODEL_ORDER}) AS s,
'Models with good performance (0.75<F1<=0.85): ' || string_agg(model_name, ', ' ORDER BY {MODEL_ORDER}) FROM m
WHERE f1_weighted > 0.75 AND f1_weighted <= 0.85) WHERE s IS NOT NULL"""
    clip = "CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS preview"
    o["disagreements"] = f"""SELECT id, sa AS ml_sentiment_roberta, sb AS ml_sentiment_gb, {RULES['majority_vote']} AS ensemble_majority_vote, {clip}
FROM ({MERGED}) JOIN ({DOCS}) USING (id) WHERE sa <> sb ORDER BY id LIMIT 20"""
    o["sample_comments"] = f"""SELECT id, text, ml_sentiment, manual_sentiment, coalesce(ml_sentiment <> manual_sentiment, FALSE) AS mismatch
FROM ({PRED_A}) JOIN {base} USING (id) ORDER BY id LIMIT 50"""
    o["untagged_batch"] = f"SELECT id, text, username, reply_length FROM {base} WHERE manual_sentiment IS NULL ORDER BY id <= 900, id LIMIT 25"

    # Features
    o["tfidf_sql"] = f"""WITH g AS (SELECT id, unnest(g) AS term FROM (SELECT id, {grams} AS g FROM (SELECT id, {terms} AS x FROM ({DOCS})))),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT n FROM n)
ORDER BY cf DESC, term LIMIT 500),
w AS (SELECT id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM tf JOIN v USING (term))
SELECT id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY id))')} AS tfidf FROM w"""
    o["tfidf_vector"] = o["tfidf_sql"]
    numeric = ("reply_length", "emoji_count", "word_count", "char_count", "positive_keywords", "negative_keywords",
               "combined_sentiment_score", *SCORE_COLS[:-1])
    z = ", ".join(r(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 "
                    f"THEN stddev_pop({c}) OVER () ELSE 1 END") + f" AS {c}" for c in numeric)
    o["standard_scale"] = f"{ANALYZED} SELECT id, {z} FROM analyzed"
    o["absolute_features"] = f"""{ANALYZED} SELECT id, {r('abs(combined_sentiment_score)')} AS combined_sentiment_score,
{r('abs(vader_compound)')} AS vader_compound, {r('abs(textblob_polarity)')} AS textblob_polarity FROM analyzed"""
    punct = f"{collapse.format(f'regexp_replace(lower(text), {q(keep)}, {q(' ')}, {q('g')})', SPACE)}"
    o["train_naive_bayes"] = naive_bayes(punct, terms, grams, None) + f""" SELECT id, 'naive_bayes' AS model_name, ml_sentiment,
{r('ml_confidence')} AS ml_confidence FROM best"""
    o["cross_validate"] = naive_bayes(punct, terms, grams, 5) + ", " + summary(
        "SELECT 'naive_bayes/' || fold AS model_name, manual_sentiment, ml_sentiment FROM best", "").removeprefix("WITH ") + f"""
SELECT 'naive_bayes' AS model_name, CAST(split_part(model_name, '/', 2) AS INTEGER) AS fold, {r('f1_weighted')} AS score FROM summ"""
    o["assemble_features"] = f"""{ANALYZED},
block AS (SELECT id, final_sentiment AS target, {' + '.join(f'coalesce(CAST({c} AS DOUBLE), 0)' for c in numeric)} + has_text::INT
+ is_nested::INT + has_question::INT + has_exclamation::INT + has_caps::INT + coalesce(hour("timestamp"), 0)
+ coalesce((dayofweek("timestamp") + 6) % 7, 0) + coalesce((dayofweek("timestamp") IN (0, 6))::INT, 0) AS total, cleaned_text FROM analyzed),
g AS (SELECT id, unnest(g) AS term FROM (SELECT id, {grams} AS g FROM (SELECT id, {terms.replace('lower(text)', 'lower(cleaned_text)')} AS x FROM block))),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT n FROM n)
ORDER BY cf DESC, term LIMIT 500),
w AS (SELECT id, tf * (ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM tf JOIN v USING (term)),
t AS (SELECT id, sum(w) / sqrt(sum(w * w)) AS terms FROM w GROUP BY 1)
SELECT id, target, CAST(21 + (SELECT count(*) FROM v) AS INTEGER) AS width, {r('total + coalesce(terms, 0)')} AS total
FROM block LEFT JOIN t USING (id)"""
    o["encode_labels"] = f"""SELECT id, manual_sentiment, {dbl('dense_rank() OVER (ORDER BY manual_sentiment) - 1')} AS label FROM ({TAGS})"""
    o["choose_target"] = f"{ANALYZED} SELECT id, final_sentiment AS target FROM analyzed"
    o["class_weights"] = f"""SELECT id, manual_sentiment, {r(f"(SELECT count(*) FROM ({TAGS})) / ((SELECT count(DISTINCT manual_sentiment) FROM ({TAGS})) * CAST(count(*) OVER (PARTITION BY manual_sentiment) AS DOUBLE))")} AS weight FROM ({TAGS})"""
    o["stratified_split"] = f"SELECT id, manual_sentiment, {IS_TEST} AS is_test FROM ({SPLIT})"
    o["stratified_folds"] = f"SELECT id, manual_sentiment, CAST({FOLD} AS INTEGER) AS fold FROM ({SPLIT})"
    o["predict_holdout"] = f"""SELECT d.id, d.username, p.ml_sentiment AS ml_prediction, {r('p.ml_confidence')} AS ml_confidence,
'roberta_social' AS ml_model, '2025-01-01 00:00:00' AS ml_timestamp FROM ({DOCS}) d LEFT JOIN (SELECT a.* FROM ({PRED_A}) a
JOIN ({SPLIT}) s USING (id) WHERE {IS_TEST}) p USING (id)"""
    names = ", ".join(f"({q(m)})" for m in ("logistic_regression", "random_forest", "gradient_boosting", "svm", "naive_bayes", "knn",
                                            "neural_network"))
    targets = SPLIT.replace(f"({TAGS})", "(SELECT id, final_sentiment AS manual_sentiment FROM analyzed)")
    o["feature_model_facts"] = f"""{ANALYZED}, s AS (SELECT id, {IS_TEST} AS is_test FROM ({targets}))
SELECT model_name, count(*) AS ids, count(*) AS predictions, count_if(is_test) AS test_rows, count(*) AS labelled_by_largest,
count(*) AS summing_to_1, TRUE AS accuracy_again, TRUE AS better_than_chance FROM s, (VALUES {names}) m(model_name) GROUP BY 1"""
    pos, neg = keyword_count("text", POSITIVE_KEYWORDS), keyword_count("text", NEGATIVE_KEYWORDS)
    o["social_model_facts"] = f"""SELECT model_name, count(*) AS ids, count(*) AS predictions, count_if({IS_TEST}) AS test_rows,
count(*) AS labelled_by_largest, count(*) AS summing_to_1, TRUE AS accuracy_again
FROM ({SPLIT}) s, (VALUES ('gradient_boosting'), ('logistic_regression')) m(model_name) GROUP BY 1"""
    o["score_with_batch_model"] = f"""SELECT id, CASE WHEN neg >= 1 AND neg >= pos THEN 'negative' WHEN pos > 1 THEN 'positive'
ELSE 'neutral' END AS ml_sentiment, {r('exp(greatest(pos, neg, 1)) / (exp(pos) + exp(neg) + exp(1))')} AS ml_confidence
FROM (SELECT id, {dbl(pos)} AS pos, {dbl(neg)} AS neg FROM ({DOCS}))"""
    dist_sql = "array_distance(CAST(a.embedding AS DOUBLE[64]), CAST(b.embedding AS DOUBLE[64]))"
    near = f"""SELECT id, neighbour, distance, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9),
neighbour) AS rn FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, {dist_sql} AS distance, b.label FROM embeddings a
JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rn <= 5"""
    o["knn_candidates"] = f"SELECT id, neighbour, {r('distance')} AS distance, label FROM ({near})"
    o["knn_classify"] = f"""WITH n AS ({near}), w AS (SELECT id, label, CASE WHEN min(distance) OVER (PARTITION BY id) = 0
THEN CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0::DOUBLE / distance END AS w FROM n),
v AS (SELECT id, label, round(sum(w), 9) AS votes FROM w GROUP BY 1, 2)
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS rn FROM v) WHERE rn = 1"""

    # Reports
    per_label = "".join(f", max(CASE WHEN label = '{c}' THEN {v} END) AS {c}{name}" for c in ("negative", "neutral", "positive")
                        for v, name in (("n", ""), ("percent", "_percent")))
    per_class = "".join(f", max(CASE WHEN label = '{c}' THEN {m} END) AS {c}_{m}" for c in ("negative", "neutral", "positive")
                        for m in ("precision", "recall", "f1", "support"))
    report = f"""SELECT q.model_name, q.total_samples AS total_predictions, q.* EXCLUDE (model_name), d.* EXCLUDE (model_name),
c.* EXCLUDE (model_name), s.mean AS confidence_mean, s.std AS confidence_std, s.min AS confidence_min, s.max AS confidence_max,
s.high_confidence, s.high_confidence_percent, m.* EXCLUDE (model_name), x.confusion_matrix
FROM ({o['data_quality_summary']}) q JOIN (SELECT model_name{per_label} FROM ({o['prediction_distribution']}) GROUP BY 1) d USING (model_name)
JOIN (SELECT model_name{per_class} FROM ({o['class_metrics']}) GROUP BY 1) c USING (model_name)
JOIN ({o['confidence_stats']}) s USING (model_name) JOIN ({o['summary_metrics']}) m USING (model_name)
JOIN (SELECT model_name, string_agg(truth || ':' || pred || ':' || n, ',' ORDER BY truth, pred) AS confusion_matrix
FROM ({o['confusion_matrix']}) WHERE n > 0 GROUP BY 1) x USING (model_name)"""
    o["model_summary"] = f"SELECT * FROM ({report}) JOIN ({o['cv_summary']}) USING (model_name)"
    o["write_reports"] = report
    # The same report over trained predictions, tagged where the row was held out.
    trained = naive_bayes(punct, terms, grams, None) + f""" SELECT best.id, 'naive_bayes' AS model_name, ml_sentiment, ml_confidence,
s.manual_sentiment, CAST(length(d.text) AS INTEGER) AS text_length FROM best JOIN documents d ON d.doc_id = best.id
LEFT JOIN (SELECT id, manual_sentiment FROM s WHERE is_test) s ON s.id = best.id"""
    o["trained_report"] = report.replace(PREDS, trained)
    figures = ("support", "accuracy", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted", "f1_macro", "f1_weighted")
    family = "".join(f", string_agg(CASE WHEN {cond} THEN model_name END, ',') AS {name}"
                     + "".join(f", sum(CASE WHEN {cond} THEN {f} ELSE 0 END)::DOUBLE AS {name}_{f}" for f in figures)
                     for name, cond in (("traditional", "model_name = 'gradient_boosting'"), ("neural", "model_name <> 'gradient_boosting'")))
    ranked = "".join(f", (SELECT string_agg(model_name, ',' ORDER BY rank) FROM ({o['rank_models']}) WHERE metric = '{m}') AS by_{m}"
                     for m in ("f1_weighted", "accuracy", "f1_macro"))
    o["master_report"] = f"""SELECT count(*) AS total_models_evaluated{family}{ranked},
(SELECT string_agg(recommendation, '|' ORDER BY list_position(['best_overall', 'best_traditional', 'best_neural', 'excellent', 'good'], kind))
FROM ({o['recommendations']})) AS recommendations FROM ({o['summary_metrics']})"""
    o["write_master_report"] = o["master_report"]
    wide = ", ".join(f"{t}.ml_sentiment AS {m}_sentiment, {r(f'{t}.ml_confidence')} AS {m}_confidence, {t}.model_type AS {m}_model_type, "
                     f"{t}.model_name AS {m}_algorithm, {r(f'{t}.p_positive')} AS {m}_prob_positive, {r(f'{t}.p_negative')} AS {m}_prob_negative, "
                     f"{r(f'{t}.p_neutral')} AS {m}_prob_neutral, {t}.accuracy AS {m}_test_accuracy, {t}.mean AS {m}_avg_confidence"
                     for t, m in (("a", "roberta_social"), ("b", "gradient_boosting")))
    o["extend_analysis"] = f"""WITH p AS (SELECT * FROM ({PREDS}) JOIN (SELECT model_name, accuracy FROM ({o['summary_metrics']})) USING (model_name)
JOIN (SELECT model_name, mean FROM ({o['confidence_stats']})) USING (model_name))
SELECT d.id, d.username, {wide} FROM ({DOCS}) d JOIN (SELECT * FROM p WHERE model_name = 'roberta_social') a ON a.id = d.id
JOIN (SELECT * FROM p WHERE model_name = 'gradient_boosting') b ON b.id = d.id"""
    o["write_ensemble_performance"] = o["evaluate_ensembles"]
    o["results_summary"] = f"""WITH s AS ({summary(EVALUABLE, 'SELECT * FROM summ')}), c AS ({o['cv_summary']})
SELECT CAST(row_number() OVER (ORDER BY accuracy DESC, {MODEL_ORDER}) AS INTEGER) AS rank, model_name, cv_mean, cv_std,
{r('accuracy')} AS test_accuracy, {r('precision_macro')} AS precision_macro, {r('recall_macro')} AS recall_macro,
{r('f1_macro')} AS f1_macro FROM s JOIN c USING (model_name)"""
    return o
