"""Table schemas, label vocabulary and other values fixed by the data formats."""

from pyspark.sql import types as T

# The three sentiment labels, in the order reports list them.
LABELS = ("positive", "neutral", "negative")

# Tokens a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

COMMENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("reply_length", T.IntegerType()),
])

TAGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("manual_sentiment", T.StringType()),
    T.StructField("is_tagged", T.StringType()),
])

REPLY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("reply_count", T.IntegerType()),
])

REPLY_PAGE = T.StructType([
    T.StructField("data", T.ArrayType(REPLY)),
    T.StructField("paging", T.StructType([
        T.StructField("cursors", T.StructType([T.StructField("after", T.StringType())])),
        T.StructField("next", T.StringType()),
    ])),
])
