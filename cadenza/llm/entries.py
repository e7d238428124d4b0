"""The registered queries of the operators, one per operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import fingerprint, html, langid, leaks, mixing, neardup, ngram, sharding, substring, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


#: Rules that hold before the method is asked.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.UrlModel(urls.seed_urls())
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES, model)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "sampled")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(_table(spark, sf_dir, "documents"), langid.held_out(parts=7))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.held_out()
    profiles = langid.learn(docs.where(~out))
    return langid.identify(docs.select("doc_id", out.alias("held_out"), "text"), profiles).drop("text")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(_table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_table(spark, sf_dir, "documents"), size=2)


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_url_filter": op2_url_filter,
    "op3_source_mixing": op3_source_mixing,
    "op4_lm_score": op4_lm_score,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_sharding": op8_sharding,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeated_substrings": op10_repeated_substrings,
    "pipeline": corpus_pipeline.run,
}


def oracles() -> dict[str, str]:
    slot, shard = sharding.place_sql()
    out = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return out | {
        "op3_source_mixing": mixing.mix_sql(),
        "op9_near_duplicates": neardup.components_sql(),
        "op8_sharding": f"SELECT doc_id, source, n_chars, slot, {shard} AS shard FROM (SELECT *, {slot} AS slot FROM documents)",
    }
