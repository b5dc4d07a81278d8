"""The queries of this subpackage: name -> (function of session and folder, SQL text or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.llm import counting, decontamination, extraction, jaccard, metric, packing, reputation, secret_scan, suffixes, tokenfile, toxicity, vector_codes, whitening
from isoreach.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op2_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge_urls(table(spark, sf_dir, "pages"))


def vocabulary(name: str) -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.neighbours(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    tokenfile.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return tokenfile.documents(spark, path)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs, length=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), length=2048, end_id=1, with_ids=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no 64-bit number holds (from some 700,000 distinct vectors on) is null here; the operator has it."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


ENTRIES = {
    "op1_extraction": (op1_extraction, None),
    "op2_reputation": (op2_reputation, reputation.judge_sql()),
    "op3_metric": (op3_metric, None),
    "op4_jaccard": (op4_jaccard, None),
    "op5_tokenfile": (op5_tokenfile, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_suffixes": (op7_suffixes, None),
    "op8_packing": (op8_packing, None),
    "op9_token_counts": (op9_token_counts, None),
    "op10_decontamination": (op10_decontamination, None),
    "op11_vector_codes": (op11_vector_codes, vector_codes.compress_sql()),
    "op12_secret_scan": (op12_secret_scan, None),
    "op13_whitening": (op13_whitening, None),
}
