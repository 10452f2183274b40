"""Result tables and reports as files."""

from pyspark.sql import functions as F

# Fixed value: timestamps in CSV keep microseconds.
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_table(df, path, fmt="parquet", mode="errorifexists"):
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False, timestampFormat=TIMESTAMP).csv(path)
    else:
        writer.format(fmt).save(path)


def per_model_columns(predictions, classes=("positive", "negative", "neutral")):
    """Generic output columns: class probabilities unfolded, the model's name in every name column."""
    probs = [F.try_element_at("ml_probs", F.lit(c)).alias(f"ml_prob_{c}") for c in classes]
    rest = [c for c in predictions.columns if c != "ml_probs"]
    return predictions.select(*rest, *probs, F.col("model_name").alias("algorithm_name"))


def write_per_model(predictions, path):
    """One folder per model, all models in one job."""
    per_model_columns(predictions).write.partitionBy("model_name").parquet(path)


def write_reports(reports, path):
    """Nested report rows as JSON documents."""
    reports.write.json(path)


def write_ensemble(merged, performance, path):
    """The merged rows with their ensemble columns, and the performance table."""
    merged.write.parquet(f"{path}/rows")
    performance.write.parquet(f"{path}/performance")
