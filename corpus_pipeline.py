"""A training corpus from raw documents, in five stages. Each works on all rows its predecessor kept; all but the last return the
columns of documents as they are, also those that bear the name of a column an operator makes; the last replaces such columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.decontaminate import find_leaks
from tablewise.llm.mixing import mix_sources
from tablewise.llm.neardup import near_duplicates
from tablewise.llm.pii import find_pii
from tablewise.llm.quality import score_quality
from tablewise.llm.shared import aside, stash, word_count
from tablewise.session import configure


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer rejects go."""
    docs, back = aside(docs, {"quality_vote", "quality", "keep"})
    return score_quality(docs).where("keep").select(back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id. Five-word shingles, similarity 0.8."""
    found = near_duplicates(docs, width=5)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    docs, back = aside(docs, {"leaks"})
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("leaks") == 0).select(back)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to placeholders, n_chars follows the new text."""
    docs, back = aside(docs, {"pii_base", "pii_added", "pii_redacted"})
    found = find_pii(docs).withColumn("text", F.col("pii_redacted"))
    if "n_chars" in docs.columns:
        changed = F.size("pii_base") + F.size("pii_added") > 0
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document with its number of copies; those that the mix leaves out go."""
    return mix_sources(docs, word_count(F.col("text"))).where("copies > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL can express neither a fitted scorer nor verified components; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
