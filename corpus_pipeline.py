"""A corpus pipeline over `documents`: five stages, each of which works on all that the one before it kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from lodestone.llm.common import keep, table
from lodestone.llm.queries import tokenizer_file

#: A document is rejected from this probability of being toxic on.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under TOXIC. The lexicon is learnt from labelled rows among docs."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2)
    return toxicity.score(docs, lexicon, "_toxicity").where(F.col("_toxicity.score") < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that resemble a line before them."""
    return line_dedup.without_repeated_lines(docs).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram links join, the one of the smallest id; documents of a null id stay."""
    parts = ngram_join.similar_documents(docs)
    gone = keep(parts.where("doc_id != component_id").select(F.col("doc_id").alias("_gone_id")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words stands in benchmark passages."""
    marked = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), out="_contamination")
    return marked.where(~F.col("_contamination.contaminated")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard", keep_one_of_each_group), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL can express neither the toxicity score nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
