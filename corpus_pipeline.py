"""A corpus pipeline of five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pieces, quality
from tessera.llm.common import bounded_batches, table, written
from tessera.llm.decontaminate import decontaminate
from tessera.llm.lines import line_dedup
from tessera.llm.simhash import without_near_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the ordinal classifier, fitted on the labelled ones, takes for good."""
    bounded_batches(spark)
    model = quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.grade(docs, model, keep_from=2).filter("keep").select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that three or more documents share out of all but the last of these; all documents stay."""
    return line_dedup(docs, min_docs=3, min_chars=20).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group of near copies: 5-word shingles, similarity of 0.8 or more."""
    return without_near_copies(docs, width=5, similarity=0.8).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up a twentieth or more."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13, share=20).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text into piece ids, and decodes these again."""
    import public_tokenizers

    bounded_batches(spark)
    vocabulary = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", piece_ids),
]

#: A fitted classifier and near copies by SimHash can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
