"""A corpus pipeline over documents: language, near duplicates, benchmark passages, personal data, mixture.

Each stage is written as Parquet in the shared folder and read again by the next one. Rows that a stage
does not reject keep their columns; the last stage gives the mixture, texts in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import decontam, jaccard, langid, mixing, pii
from evispark.llm.texts import read_table, small_batches, with_ids
from evispark.shared import materialize, temporary_tables

#: A document whose languages are too mixed for one to hold this share is rejected, as is one without letters.
LEAST_LANGUAGE = 0.4
#: Near copies share this percentage of their shingles of so many words.
SHINGLE_WORDS, LIKE_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, judged by their text alone; learned from the column lang of all of them.

    A null or empty text, or one without a letter, has no language and goes; so does every text where
    no row has a lang. Repeated rows fare alike, equal shares go to the first language. An empty table
    stays empty. Other columns stay as they are.
    """
    small_batches(spark)
    langs, model = langid.learn(docs)
    return langid.with_language(docs, langs, model, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the least doc_id; a row with a doc_id comes before one without.

    Rows are told apart by a number of their own, so rows that repeat a doc_id stay if their texts
    differ; repeated rows are copies. Null and empty texts are near to nothing and stay. Of equal
    doc_ids in a class one row stays. An empty table stays empty. Other columns stay as they are.
    """
    small_batches(spark)
    row = next(c for c in ("row_number", *(f"row_number_{k}" for k in range(len(docs.columns)))) if c not in docs.columns)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = materialize(jaccard.link_classes(numbered.select(row, "text"), row, SHINGLE_WORDS, LIKE_PERCENT), "classes")
    others = classes.where(F.col("component_id") != F.col(row)).select(row, "component_id")
    members = others.union(others.select(F.col("component_id").alias(row), "component_id").distinct())
    ranked = members.join(numbered.select(row, "doc_id"), row).select("component_id", row, F.struct(F.isnull("doc_id").alias("none"), "doc_id", row).alias("place"))
    ranked = materialize(ranked, "ranked")
    first = ranked.groupBy("component_id").agg(F.min("place")[row].alias(row)).select(row)
    return with_ids(numbered, ranked.select(row).join(first, row, "left_anti"), row, wanted=False).drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay, as all do where the benchmark is empty. Repeated rows
    fare alike. Whole texts are searched. Other columns stay as they are.
    """
    return decontam.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in text replaced by its kind, n_chars counted anew.

    A null text stays null. Where spans overlap, the first one and of equal starts the longest names
    what replaces them. Repeated rows fare alike. Other columns stay as they are.
    """
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, texts and all, with size, source_size, target, taken and first_slot.

    Sorted by first_slot this is the training mix. Texts without words, null ones among them, are not
    taken; a null source is one. An empty table gives an empty mix.
    """
    return mixing.take(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Language inference, classes of links and the schedule of the mixture are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them is written and read again, and deleted when the mix is written."""
    docs = read_table(spark, sf_dir, "documents")
    with temporary_tables(spark):
        for name, stage in STAGES[:-1]:
            with temporary_tables(spark):
                docs = materialize(stage(spark, docs, sf_dir), name, outlives=True)
        name, stage = STAGES[-1]
        docs = materialize(stage(spark, docs, sf_dir), name, outlives=True)
    return docs
