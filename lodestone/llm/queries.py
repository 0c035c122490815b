"""The registered queries of this package: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, html_text, licenses, line_dedup, ngram_join, ngram_lm, packing, quality, spelling, token_counts, toxicity, whitening
from .common import crc32_mod, table
from .oracle import ORACLE_SQL


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, meta = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), ("n_chars",)
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, meta)
    scored = quality.score(docs, machine, meta)
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_counts.token_counts(F.col("text"), tokenizer_file("piece_bpe_32k.model")).alias("t")).select("doc_id", "t.*")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2)
    scored = toxicity.score(docs, lexicon).withColumn("score", F.col("toxicity.score"))
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("toxicity.segments").alias("n_segments"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), repeated="n_repeated")
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return marked.select("doc_id", c.n_words, c.n_hit, F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c.contaminated).toDF("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.without_repeated_lines(docs, out="n_removed")
    return kept.select("doc_id", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 10) == 0)


QUERIES = {f.__name__: f for f in (op1_quality, op2_embedding_near_dedup, op3_token_counts, op4_packing, op5_ngram_jaccard, op6_toxicity, op7_license_scan, op8_html_extraction, op9_decontamination, op10_line_dedup, op11_spelling_variants, op12_embedding_whitening, op13_lm_scoring)}
