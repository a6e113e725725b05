"""The corpus pipeline: language ID, near-duplicates, repeated strings, benchmark leaks, mixing.

Every stage takes any columns beside doc_id, text, lang and source (whatever their names, but for those that begin with
`__`), gives no rows for an empty table, and treats repeated rows, ties, nulls and very long texts as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, langid, mixing, repeats, simhash
from tickloom.llm.common import clear, materialise, table, written

_OWN = "__pipeline_"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty or letterless text) go; `lang` of the others is the one found in their text.

    Where no language could be learned, documents with letters stay as they are.
    """
    found = langid.identify(docs, prefix=_OWN).where(f"{_OWN}has_letter")
    if "lang" not in docs.columns:
        return found.select(docs.columns)
    known = F.when(F.col(f"{_OWN}lang_pred") != "und", F.col(f"{_OWN}lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", known).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id, null last; of repeated rows one stays."""
    return simhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that occur elsewhere are cut out of the texts; n_chars follows; null texts stay null."""
    kept = repeats.without_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; without a benchmark all stay."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), prefix=_OWN)
    return found.where(~F.col(f"{_OWN}contaminated")).select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is kept, whole documents mixed to the target weights, in training order: all their columns, and how many words the mix
    takes of each, and where; null texts take nothing, null is a source."""
    return mixing.mix(docs, whole=True)


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing", mixing_sources),
]

#: SQL can express neither the learned language model nor the hash-based mixing order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself, and the stage before it, go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    first = written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
            clear(spark, docs, first)
    return docs
