"""The registered queries of this subpackage; each runs its operator over the whole tables."""

from pyspark.sql import functions as F

from commentlake.llm import (
    bottomk, cuckoo, line_dedup, merkle, minhash, mixing, preference, privacy, revisits, sharding, toxicity, whitening,
    winnowing)

MIX_TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.9}  # exponents of the observed token shares


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_count(spans, kind):
    """Number of spans of a kind. (A second parameter of the lambda, even one with a default, would be the place in the array.)"""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_pii_skip_chain_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = privacy.find_private(docs, privacy.fit(docs))
    counts = [kind_count("base", k).alias(f"n_{name}") for k, name in enumerate(privacy.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(privacy.span_text(F.col("base")), 256).alias("base_sha256"),
        privacy.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), "settled")


def op2_minmax_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_raked_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", mixing.topic_by_marks(F.col("text")).alias("topic"), mixing.tokens(F.col("text")).alias("tokens"))
    return mixing.mix(docs, MIX_TARGETS).withColumns({c: F.round(c, 6) for c in ("weight", "probability", "margin_gap")})


def op4_bottomk_fingerprint(spark, sf_dir):
    return bottomk.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op5_stratified_shards(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.interleave(rows, 16, ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def remainder(n):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op6_subword_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_revisit_resolution(spark, sf_dir):
    resolved = revisits.resolve_revisits(revisits.records_of_pages(table(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", revisits.header_text(F.col("headers")))


def op8_pairwise_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = preference.fit(docs, labels.where(remainder(5) != 0))
    return preference.score(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_winnowing_decontamination(spark, sf_dir):
    found = winnowing.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_segment_line_dedup(spark, sf_dir):
    """Lines of eight characters or more with up to three edits are linked; shorter ones are compared as a whole."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), threshold=3, min_chars=8, short_copies=True)


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = merkle.manifest(merkle.leaves(docs, F.coalesce(remainder(3) == 0, F.lit(False)) & F.col("doc_id").isNotNull()), "leaf", "lang")
    rows = found.withColumn("folded_root", merkle.fold(F.col("path"), F.coalesce("tampered", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_cholesky_whitening(spark, sf_dir):
    vectors = whitening.integers(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_cuckoo_exact_dedup(spark, sf_dir):
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


OPERATORS = (
    op1_pii_skip_chain_crf, op2_minmax_near_dedup, op3_raked_mixture, op4_bottomk_fingerprint, op5_stratified_shards,
    op6_subword_toxicity, op7_revisit_resolution, op8_pairwise_quality, op9_winnowing_decontamination, op10_segment_line_dedup,
    op11_merkle_manifest, op12_cholesky_whitening, op13_cuckoo_exact_dedup)


def llm_queries():
    return {q.__name__: q for q in (*OPERATORS, pipeline)}
