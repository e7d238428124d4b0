"""Parsers of detector logs. All take lines(source_id, line_no, value), as `spark.read.text` gives them with a line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import round_half_up
from cadenza.operators.intervals import merge

_NUMBER = r"(-?\d+(?:\.\d+)?)"
BY = ["source_id"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, numbered within each file; source_id is the file's name."""
    whole = spark.read.text(path, wholetext=True).withColumn("source_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
    return whole.select("source_id", F.posexplode(F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n")).alias("line_no", "value"))


def _seconds(value: Column, name: str) -> Column:
    return F.regexp_extract(value, f"{name}:\\s*{_NUMBER}", 1).try_cast("double")


def _pairs(lines: DataFrame, prefix: str) -> DataFrame:
    """Starts and ends in order; a later start takes the place of an open one."""
    start, end = _seconds(F.col("value"), f"{prefix}_start"), _seconds(F.col("value"), f"{prefix}_end")
    marks = lines.select(*BY, "line_no", start.alias("s"), end.alias("e")).where("s IS NOT NULL OR e IS NOT NULL")
    order = Window.partitionBy(*BY).orderBy("line_no")
    return marks.withColumn("next_e", F.lead("e").over(order)).withColumn("next_s", F.lead("s").over(order))


def _ms(s: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), round_half_up(s * 1000))


def silences(lines: DataFrame, lengths: DataFrame) -> DataFrame:
    """silence_start / silence_end; a start that nothing closes ends with the source if it comes before that."""
    rows = _pairs(lines, "silence").where("s IS NOT NULL").join(lengths.select(*BY, "duration_ms"), BY, "left")
    closed = F.when(F.col("next_e").isNotNull(), round_half_up(F.col("next_e") * 1000)).when(F.col("next_s").isNull() & (F.col("duration_ms") > _ms(F.col("s"))), F.col("duration_ms"))
    out = rows.select(*BY, _ms(F.col("s")).alias("start_ms"), closed.alias("end_ms")).where("end_ms IS NOT NULL")
    return out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def freezes(lines: DataFrame) -> DataFrame:
    """freeze_start / freeze_end; a start that nothing closes is dropped."""
    rows = _pairs(lines, "freeze").where("s IS NOT NULL AND next_e IS NOT NULL")
    return rows.select(*BY, _ms(F.col("s")).alias("start_ms"), round_half_up(F.col("next_e") * 1000).alias("end_ms"), F.lit("frozen").alias("kind"))


def blacks(lines: DataFrame) -> DataFrame:
    s, e = _seconds(F.col("value"), "black_start"), _seconds(F.col("value"), "black_end")
    return lines.select(*BY, _ms(s).alias("start_ms"), round_half_up(e * 1000).alias("end_ms"), F.lit("black").alias("kind")).where("start_ms IS NOT NULL AND end_ms IS NOT NULL")


def clipping(lines: DataFrame, lengths: DataFrame, limit_db: float = -1.0) -> DataFrame:
    """One row for the whole source if the highest finite peak level reaches the limit."""
    peak = _seconds(F.col("value"), "Peak level dB")
    top = lines.select(*BY, peak.alias("peak")).groupBy(*BY).agg(F.max("peak").alias("peak_db")).where(F.col("peak_db") >= limit_db)
    return top.join(lengths.select(*BY, "duration_ms"), BY).select(*BY, F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit("clipping").alias("kind"), "peak_db")


def level_frames(lines: DataFrame) -> DataFrame:
    """Levels with the latest time before them that no other level took; `-inf` is minus infinity."""
    t = F.regexp_extract("value", f"pts_time:\\s*{_NUMBER}", 1).try_cast("double")
    raw = F.regexp_extract("value", r"RMS_level=\s*(-?inf|-?\d+(?:\.\d+)?)", 1)
    db = F.when(raw == "-inf", F.lit(float("-inf"))).otherwise(raw.try_cast("double"))
    marks = lines.select(*BY, "line_no", t.alias("t"), db.alias("db")).where("t IS NOT NULL OR db IS NOT NULL")
    order = Window.partitionBy(*BY).orderBy("line_no")
    rows = marks.withColumn("t_s", F.lag("t").over(order)).where("db IS NOT NULL AND t_s IS NOT NULL")
    return rows.select(*BY, "line_no", "t_s", F.col("db").alias("rms_db"))


def progress(lines: DataFrame) -> DataFrame:
    """Blocks of key=value lines, each closed by a `progress=` line, as maps."""
    pair = F.split("value", "=", 2)
    rows = lines.where(F.contains("value", F.lit("="))).select(*BY, "line_no", F.trim(pair[0]).alias("k"), F.trim(pair[1]).alias("v"))
    order = Window.partitionBy(*BY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", F.coalesce(F.sum((F.col("k") == "progress").cast("int")).over(order), F.lit(0)))
    last = rows.groupBy(*BY, "block", "k").agg(F.max_by("v", "line_no").alias("v"))
    return last.groupBy(*BY, "block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("entries")).where(F.col("entries")["progress"].isNotNull())


def nonspeech_spans(scores: DataFrame, step_s: float = 0.32, width_s: float = 0.64, below: float = 0.30) -> DataFrame:
    """Touching windows of scores(source_id, t_s, score) under the limit, as spans."""
    low = scores.where(F.col("score") < below)
    return merge(low.select(*BY, round_half_up(F.col("t_s") * 1000).alias("start_ms"), round_half_up((F.col("t_s") + width_s) * 1000).alias("end_ms")), BY)
