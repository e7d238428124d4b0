"""A corpus pipeline over `documents`: each stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. The driver, or `run`, writes it as Parquet and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import langid, leaks, mixing, neardup, sharding
from cadenza.llm._store import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are learned from the documents with a language; what has no language (no text, no
    letter) goes; a missing language is filled in.

    If no document has a language nothing can be told, so all go. Repeated rows and rows without a key are judged
    each for itself; other columns than those of documents are left out."""
    judged = langid.identify(docs, langid.learn(docs))
    return judged.where("lang_pred != 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least doc_id stays. Rows of one key are one
    document; rows without a key can't be told apart and stay, as do those without words. An empty table stays empty.

    The few keys that go are joined to the texts, which aren't shuffled for that."""
    found = materialise(neardup.components(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")), "found")
    again = found.where("kept AND n > 1").select("doc_id")
    few = lambda ids: F.broadcast(ids) if ids.count() <= neardup.MOST_BROADCAST else ids
    once = docs.join(few(found.where("NOT kept OR n > 1").select("doc_id")), "doc_id", "left_anti")
    out = once.select(*COLUMNS)
    if again.limit(1).count():
        out = out.unionByName(docs.join(few(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS))
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: all rows of their key, or without a key the row itself.

    Documents without text hold nothing and stay; without benchmark items, or of an empty table, nothing goes."""
    found = leaks.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_row=True)
    keyless = lambda row: F.when(F.col("doc_id").isNull(), row)
    gone = materialise(found.select(F.col("doc_id").alias("key"), keyless(F.col("row")).alias("row")).distinct(), "leaks")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("key")) & keyless(leaks.row_of()).eqNullSafe(F.col("row")), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their calibrated probabilities.

    A null source or language counts as the empty label, a null text as one token; rows of one key share their fate.
    An empty table stays empty."""
    return mixing.mix(docs).where("sampled").select(*COLUMNS)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with slot and shard; a null key takes the slot of the empty string, equal keys share a shard."""
    return sharding.place(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_leaks),
    ("source_mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Language profiles, sketches and latent search have no SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
