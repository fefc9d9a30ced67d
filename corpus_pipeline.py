"""From raw documents to packed token sequences: language, common lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads: doc_id, text, lang, source, n_chars; the
last returns pieces. Null and repeated values are handled as the operators say; other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm import decontamination, language_id, line_dedup, packing, simhash_dedup, tokens
from cladeworks.llm.common import table
from cladeworks.session import folder, remove, settle, temporary


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes their lang; those without text or letters go."""
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, profiles, "source", keep_text=True).where("lang_pred <> 'und'")
    return _documents(found.withColumnRenamed("lang_pred", "lang"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least ten of them have."""
    return _documents(line_dedup.drop_common_lines(docs, "lang", "source").withColumnRenamed("kept", "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (null: last), then the smallest hash of its text."""
    return _documents(simhash_dedup.drop_near_duplicates(docs, "lang", "source"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontamination.find_benchmark(docs, table(spark, sf_dir, "benchmark"), "lang", "source", keep_text=True)
    return _documents(found.where(~F.col("contaminated")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences."""
    return packing.pack_documents(docs, tokens.default_path())


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written and read again.

    What a stage writes on its way is removed when the stage is over, and what it returned when the next one is; the
    result reads what the last but one returned, which stays.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = folder(spark, name.replace(" ", "-"))
        with temporary(spark):
            docs = settle(stage(spark, docs, sf_dir), path=path)
        remove(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
