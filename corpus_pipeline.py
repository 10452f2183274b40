"""Corpus pipeline: documents to a clean, mixed and sharded training set, every stage written and read again."""

from pyspark.sql import functions as F

from commentlake.llm import minhash, mixing, sharding, toxicity, winnowing
from commentlake.llm.queries import table
from commentlake.session import scratch_path

#: Exponents of the observed token shares: sources and languages are flattened a little, topics keep their shares.
TARGETS = {"source": 0.9, "lang": 0.9, "topic": 1.0}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs, sf_dir):
    """Operator 6: documents scored 0.7 or more go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), 0.7)


def drop_near_duplicates(spark, docs, sf_dir):
    """Operator 2: five-word shingles at a similarity of 0.8; the least doc_id of each group stays."""
    return minhash.keep_one(docs, shingle=5, percent=80, bands=40, rows=4)


def drop_contaminated(spark, docs, sf_dir):
    """Operator 9: documents that share a window with a benchmark item go."""
    return winnowing.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Operator 3: documents are sampled by their calibrated probability."""
    sized = docs.withColumns({"_topic": mixing.topic_by_marks(F.col("text")), "_tokens": mixing.tokens(F.col("text"))})
    targets = {"source": TARGETS["source"], "lang": TARGETS["lang"], "_topic": TARGETS["topic"]}
    return mixing.mix(sized, targets, size="_tokens").where("sampled").select(*docs.columns)


def shard(spark, docs, sf_dir):
    """Operator 5: 16 shards of equal numbers of rows that all match the mixture."""
    return sharding.interleave(docs, 16, ties=("n_chars", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained model, which SQL cannot express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
