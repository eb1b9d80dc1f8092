"""Corpus pipeline: filter and clean ``documents`` in five stages, each written as Parquet and read by the next.

1. language_id: documents without a recognisable language go.
2. line_dedup: repeated and nearly repeated lines go; a document of which nothing is left goes.
3. near_duplicates: one document of each component of near copies stays.
4. decontamination: benchmark passages are cut out; a document that is half benchmark goes.
5. segmentations: sampled token sequences of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranchery.llm import decontaminate, jaccard_join, language_id, line_dedup, segment_sampling
from tranchery.llm.queries import SEGMENT_SAMPLES, SUBWORD_MODEL
from tranchery.llm.shared import staged, table
from tranchery.llm.token_cache import tokenizer_path


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the number of characters that the texts now have."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; drops those whose language is unknown.  Where no document is labelled, those
    with a letter stay."""
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(docs, model)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup.drop_emptied(line_dedup.dedup(docs)), docs.columns)


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs).select(*docs.columns)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def by_segments(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segment_sampling.sample_segmentations(docs, tokenizer_path(SUBWORD_MODEL), k=SEGMENT_SAMPLES)


STAGES = [
    ("language_id", by_language),
    ("line_dedup", by_lines),
    ("near_duplicates", by_near_copies),
    ("decontamination", by_benchmark),
    ("segmentations", by_segments),
]

#: Language identification, the sampling and the component search have no SQL form; tests/llm/test_pipeline.py holds
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
