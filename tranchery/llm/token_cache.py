"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content together with the digest of the tokenizer file.  Keys are joined
to the stored counts; only distinct misses are encoded, and their counts are appended to the cache (Parquet, one
append per run, keyed by tokenizer version, so that another tokenizer never reads these counts).  The text of a miss
is shuffled once, by its key, after equal texts of a task were put together, so a much repeated text is no hot key.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); equal texts share one cache row; an empty table gives
an empty result and leaves the cache as it is; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.llm.shared import in_batches
from tranchery.llm.text import pieces_of

CACHE_SCHEMA = "version string, digest string, n_tokens long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer_version(name: str) -> str:
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def _counter(name: str):
    """A function from texts to token counts, without begin, end or added special tokens: .json files belong to
    ``tokenizers`` (special strings in a text as its default has them), .model files to ``sentencepiece``."""
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def encode_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def run(batches):
        count = _counter(tokenizer)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                counts = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return in_batches(texts.select("digest", "text")).mapInArrow(run, "digest string, n_tokens long")


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text", normalise=None) -> DataFrame:
    """Per document: id, n_bytes and n_tokens.  ``cache_path`` is a Parquet folder in storage that all executors share.

    ``normalise`` is a Column function applied before digest and encoding (default: the content as it is, since a
    count must be that of the exact text); n_bytes is that of the given text.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = normalise(F.col("text")) if normalise else F.col("text")
    keyed = given.select("doc_id", body.alias("text"), F.octet_length("text").cast("long").alias("n_bytes")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    stored = read_cache(spark, cache_path).where(F.col("version") == version).select("digest", "n_tokens")
    misses = keyed.select("digest", "text").join(stored.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    counted = encode_counts(misses, tokenizer).select(F.lit(version).alias("version"), "digest", "n_tokens")
    counted.write.mode("append").parquet(cache_path)
    # two runs at once may both append a key: the count is the same, one row of each is kept
    now = read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.select("doc_id", "digest", "n_bytes").join(now, "digest").select(F.col("doc_id").alias(doc_id), "n_bytes", "n_tokens")


def read_cache(spark, cache_path: str) -> DataFrame:
    """The stored counts; a cache that is not there yet is empty."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)
