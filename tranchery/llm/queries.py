"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranchery.llm import decontaminate, jaccard_join, language_id, lattice_score, license_scan, line_dedup, merkle_manifest, secret_scan, segment_sampling, simhash, token_cache, weak_quality, zone_clusters
from tranchery.llm.check_sql import SQL  # noqa: F401
from tranchery.llm.shared import fresh_path, table


SUBWORD_MODEL = "piece_bpe_32k.model"
SEGMENT_SAMPLES = 3


def op1_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_sampling.sample_segmentations(table(spark, sf_dir, "documents"), token_cache.tokenizer_path(SUBWORD_MODEL), k=SEGMENT_SAMPLES, ids=False, chunk=2 << 20)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language_id.fold("doc_id", 10) == 0)
    return lattice_score.score(docs, ~F.col("held_out"), token_cache.tokenizer_path(SUBWORD_MODEL), keep=["doc_id", "held_out"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_exact", "n_near", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_cache.token_counts(table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.fold("doc_id", 4) == 2)
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",")
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["licence"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", "n_sentences", F.size("found").cast("long").alias("n_known"), F.array_join("found.sentence_id", ",").alias("sentence_ids"), names.alias("licences"), spans.alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weak_quality.score(table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    kept = ~failed & (F.col("quality") >= weak_quality.THRESHOLD)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op11_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clusters.with_inertia(*zone_clusters.cluster(table(spark, sf_dir, "embeddings")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proved = merkle_manifest.verify(*merkle_manifest.manifest(table(spark, sf_dir, "documents"), tampers=tampers))
    return proved.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_segmentations, op2_jaccard_join, op3_lm_scores, op4_line_dedup, op5_token_counts, op6_language_id, op7_license_scan, op8_quality_rules, op9_secret_scan, op10_decontamination, op11_simhash_classes, op12_zone_clusters, op13_merkle_manifest)}

