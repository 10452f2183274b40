"""Comment tables from CSV or Parquet, and the tags they already carry."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlake.functions.text import strip
from commentlake.schema import COMMENTS, LABELS, NA_TOKENS
from commentlake.sources.csv_records import read_csv


def read_comments(spark, path, schema=COMMENTS, na_tokens=True, required=("text",), fmt="csv"):
    """A comment table with a declared schema.

    CSV fields may be quoted and span lines; columns are taken by each file's own header, and a large file is read by many tasks.
    Missing-value tokens become null unless `na_tokens` is off; a missing required column is an error.
    """
    if fmt != "csv":
        df = spark.read.schema(schema).format(fmt).load(path)
        _require(spark.read.format(fmt).load(path).columns, required)
        return _nullify(df, NA_TOKENS) if na_tokens else df
    raw = read_csv(spark, path)
    _require(raw.columns, required)
    if na_tokens:
        raw = _nullify(raw, NA_TOKENS)
    # Typed columns are parsed leniently after the text is read.
    return raw.select(*[_typed(f) for f in schema.fields if f.name in raw.columns])


def _require(columns, required):
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; available: {list(columns)}")


def _nullify(df, tokens):
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in texts})


def _typed(field):
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return c
    if isinstance(field.dataType, T.TimestampType):
        return F.try_to_timestamp(c).alias(field.name)
    return c.try_cast(field.dataType).alias(field.name)


def read_existing_tags(df):
    """First non-empty of the tag columns, lower-cased; other labels are dropped, and rows with blank text."""
    names = [c for c in ("sentiment", "manual_sentiment", "tagged_sentiment") if c in df.columns]
    tag = F.lower(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names]))
    return df.filter(strip("text") != "").withColumn("existing_tag", F.when(tag.isin(*LABELS), tag))
