"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark
decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them back as the
next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.bpe import bpe
from vigil.llm.common import remove, shared_path, table, written
from vigil.llm.decontam import decontaminate
from vigil.llm.langid import UNKNOWN, detect, evidence_of, fit, in_a_learned_language, labelled_rows
from vigil.llm.line_dedup import dedup_lines
from vigil.llm.queries import tokenizer_path
from vigil.llm.simhash import keep_one

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose letters are too unlikely
    in every learned language, also in spans of several; the others get the
    predicted language.  Model and evidence come from all labelled rows."""
    detected = written(detect(docs, fit(docs), evidence=True), "detected")
    needed = evidence_of(labelled_rows(detected))
    return detected.filter((F.col("lang_pred") != UNKNOWN) & in_a_learned_language(needed)) \
        .withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line blocks that an earlier document holds go (every pair of documents
    is aligned); documents all stay."""
    return dedup_lines(docs, all_pairs=True).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                                        .otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (4-word shingles, 4 bits) stays."""
    return keep_one(docs, shingle=4, radius=4).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 10 benchmark words go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids and decoded text, as digests, of what is left."""
    return bpe(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenize", tokenize),
]

# SQL can't express the Viterbi labels, the patience alignment, the components
# and the tokenizer; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if path:
            remove(spark, path)
        docs, path = spark.read.parquet(out), out
    return docs
