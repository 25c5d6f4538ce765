"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its
predecessor kept; all but the last return the columns of documents.

Each stage works on texts of any length and on columns of any further names, and gives an
empty table for an empty one.  Nulls, empty texts, ties and repeated rows: see the stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, line_crf, mix_flow, pack_tiers, pii_semicrf, simhash_cover
from graphloom.llm.token_parquet import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the line labelling rejects go.

    A null or empty text has no words and goes; repeated rows get the same verdict; a share of
    content lines of just one half keeps a document; other columns, null or not, don't count.
    """
    return line_crf.keep_good(docs, line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays, once.

    Fingerprints are those of op5: 3-word shingles, at most 2 differing bits.  Null and empty texts
    are one class (fingerprint zero).  Of rows with equal doc_id the one with the least text stays;
    rows without doc_id go where their class has one with it, else one of them stays.
    """
    return simhash_cover.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets, e-mail, IP, card or phone.

    All rows stay, repeated ones too; a null text stays null, an empty one empty; n_chars follows
    the new text; of overlapping spans the first one's kind stands for all.
    """
    return pii_semicrf.redact(docs, pii_semicrf.fit(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice.

    A document without id goes by a hash of its source and text; equal ones come equally often.
    A null or empty text is never taken; a null source is a source of its own; rows equal in id and
    text are taken in any order.
    """
    key = F.coalesce("doc_id", F.xxhash64("source", "text")).alias("doc_id")
    rows, _, _ = mix_flow.mix(mix_flow.sized(docs.select(key, "source", "text"), F.array("source")))
    # one row for each id: the stage before left one document for each
    times = rows.where(F.col("taken") > 0).groupBy("doc_id").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    held = docs.select(key, F.struct("*").alias("row"))  # the columns may have any names
    return held.join(times, "doc_id").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of several context sizes.

    A null or empty text is the end id alone; repeated rows, as the mixture makes them, are packed
    each; a null doc_id is carried on.
    """
    return pack_tiers.pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: No SQL says what the learned stages do; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = common.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
