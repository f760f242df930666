"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import storage
from quire.llm import common, langid, linededup, minhash, mixing, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, and doesn't refute the one they claim.

    A document goes when its text is null, empty, without letters or mostly of other signs, when no language
    leads, and when more than half of its words are in runs of other languages than the claimed one;
    see langid.language_filter. The model is fitted on the claims of docs, a bounded sample of each.
    """
    return langid.language_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines over the threshold are dropped; n_chars follows the text. No document goes.

    Copies of a text count as one document here: the next stage keeps one of them, which must not
    have been emptied for being copied. A null text stays null, with null n_chars.
    """
    return linededup.line_dedup(docs, count="texts").withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies; see minhash.near_dedup."""
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix to the production weights takes; see mixing.mix."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in packed sequences; see packing.pack."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language ID, near-dedup and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents, each stage written to the shared folder for the next.

    A stage's folder goes when the next one is written. An empty table gives an empty one. Null, empty
    and wordless texts go in the first stage, as no language is found; repeated rows and copies in the
    third; columns other than those of documents aren't there from the start.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        at = common.new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            storage.remove(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
