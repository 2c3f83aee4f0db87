"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import bpe, decontaminate, linededup, quality, simhash
from pagetide.llm.common import fresh, id_crc, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores 0.3 or more.

    Null and empty texts are scored as one empty line; equal texts stay or go together; repeated rows, null ids and extra
    columns stay as they are; an empty table gives an empty one.
    """
    labelled = table(spark, sf_dir, "labels").where(id_crc() % 5 != 0)
    return quality.keep_good(docs, quality.fit(table(spark, sf_dir, "documents"), labelled))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines of 50 words or more go; so do documents of which nothing is left.

    Null and blank texts lose no line and stay; rows of one id and text are one document and change alike; among texts of
    one id the hash of the text decides which is earlier, null ids come first; n_chars, if there is such a column,
    follows the text; extra columns stay as they are; an empty table gives an empty one.
    """
    n_lines, deleted = fresh(docs.columns, "n_lines"), fresh(docs.columns, "deleted")
    found = linededup.dedup_lines(docs, n_lines_col=n_lines, deleted_col=deleted)
    whole = F.size(deleted) == 0
    found = found.where(whole | F.col("text").rlike("[^\\x09-\\x0D\\x20]"))
    if "n_chars" in docs.columns:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(n_chars))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Candidates come from SimHash fingerprints under Golay keys, then from MinHash bands; the exact similarity decides.

    Texts without a word, null and empty ones included, are copies of each other; a null id comes last, texts of one id
    go by their hash; of repeated rows one stays; extra columns stay as they are; an empty table gives an empty one.
    """
    return simhash.keep_one(docs, width=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edits in a fifth of its words allowed.

    Null and empty texts hold nothing and stay; null and blank items match nothing; repeated rows, null ids and extra
    columns stay as they are; an empty table gives an empty one.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids of each document and the text that they decode to.

    Null and empty texts have no ids; repeated rows and null ids keep their rows; other columns are left out; an empty
    table gives an empty one.
    """
    return bpe.encode_and_decode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]
#: No stage can be said in SQL alone; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir; an empty table passes through all of them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
