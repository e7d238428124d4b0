"""The driver's tables in the roles that the operators know, in DataFrames and in DuckDB SQL.

`events` are spans of a source (the user): `view` silences, `click` words, `purchase` cuts, `signup` proposals,
`error` others; a span lasts ten minutes for each unit of value, a word a minute. `orders` are edits and their lines
segments. `documents` and `conversations` are transcripts. Times count from the first of January 2024.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIGIN_MS, MONTH_MS = 1_704_067_200_000, 2_678_400_000
#: Width of the time buckets of range joins over events: a few times a span's mean length.
BUCKET_MS = 21_600_000
KINDS = {"silences": "view", "words": "click", "cuts": "purchase", "proposals": "signup", "others": "error"}

EVENTS_SQL = f"""
ev AS (SELECT user_id AS source_id, event_id AS pos, event_type AS kind, epoch_us(ts) // 1000 - {ORIGIN_MS} AS start_ms,
  epoch_us(ts) // 1000 - {ORIGIN_MS} + CAST(floor(value * 600000 + 0.5) AS BIGINT) AS end_ms, value FROM events),
silences AS (SELECT * FROM ev WHERE kind = 'view'), cuts AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'semantic' ELSE 'silence' END AS reason FROM ev WHERE kind = 'purchase'),
proposals AS (SELECT * FROM ev WHERE kind = 'signup'), others AS (SELECT * FROM ev WHERE kind = 'error'),
words AS (SELECT source_id, pos, start_ms, start_ms + CAST(floor(value * 60000 + 0.5) AS BIGINT) AS end_ms, 'w' || (pos % 7) AS text FROM ev WHERE kind = 'click'),
lengths AS (SELECT DISTINCT source_id, CAST({MONTH_MS} AS BIGINT) AS duration_ms FROM ev)"""
SEGMENTS_SQL = """
seg AS (SELECT l_orderkey AS edl_id, CAST(l_linenumber AS BIGINT) AS pos, l_suppkey % 3 AS source_id,
  CAST(sum(l_quantity + l_linenumber) OVER w * 1000 AS BIGINT) - CAST(l_quantity * 1000 AS BIGINT) AS in_ms, CAST(sum(l_quantity + l_linenumber) OVER w * 1000 AS BIGINT) AS out_ms, l_returnflag AS flag, l_quantity AS quantity
  FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1)
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))"""


def since_origin(ts: Column) -> Column:
    """Milliseconds since the first of January 2024, whatever the session's time zone."""
    second = (F.extract(F.lit("SECOND"), ts) * 1000).cast("long")
    return F.date_diff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long") * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + second


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    start = since_origin(F.col("ts"))
    minutes = 60_000 if role == "words" else 600_000
    rows = table(spark, sf_dir, "events")
    if role:
        rows = rows.where(F.col("event_type") == KINDS[role])
    rows = rows.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), start.alias("start_ms"), (start + F.floor(F.col("value") * minutes + 0.5)).alias("end_ms"), "value")
    if role == "words":
        rows = rows.withColumn("text", F.concat(F.lit("w"), (F.col("pos") % 7).cast("string"))).drop("kind", "value")
    if role == "cuts":
        rows = rows.withColumn("reason", F.when(F.col("pos") % 3 == 0, "semantic").otherwise("silence"))
    return rows


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id")).distinct().withColumn("duration_ms", F.lit(MONTH_MS).cast("long"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as segments: each as long as its quantity in seconds, with its line number as the gap before it.

    Dealt out by order once, which serves both windows and whatever is keyed by edl_id after them."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag").repartition("l_orderkey").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    end = (F.sum(F.col("l_quantity") + F.col("l_linenumber")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) * 1000).cast("long")
    return rows.select(
        F.col("l_orderkey").alias("edl_id"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_suppkey") % 3).alias("source_id"),
        (end - (F.col("l_quantity") * 1000).cast("long")).alias("in_ms"), end.alias("out_ms"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, five seconds each."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "lang", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return rows.select("source_id", "lang", F.col("idx").cast("long").alias("idx"), "text", (F.col("idx") * 5000).cast("long").alias("start_ms"), (F.col("idx") * 5000 + 4000).cast("long").alias("end_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as text windows, ten seconds each."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), "role", "text", F.lit("en").alias("lang"), (F.col("turn") * 10000).alias("start_ms"), (F.col("turn") * 10000 + 9000).alias("end_ms"))


def turn_words(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Words of all turns of one role, 400 ms every half second."""
    rows = turns(spark, sf_dir).where(F.col("role") == role).select("source_id", F.col("pos").alias("turn"), F.posexplode(F.split(F.trim("text"), r"\s+")).alias("n", "text"))
    pos = F.row_number().over(Window.partitionBy("source_id").orderBy("turn", "n")) - 1
    return rows.withColumn("pos", pos).select("source_id", F.col("pos").cast("long").alias("pos"), "text", (F.col("pos") * 500).cast("long").alias("start_ms"), (F.col("pos") * 500 + 400).cast("long").alias("end_ms"))
