"""Readers of captions, JSON documents, samples and folders, and the writers of results."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import __version__
from cadenza.functions.jsonpath import UsageError
from cadenza.functions.scalar import bar, content_key, duration_text, timestamp_ms

INTERVAL = [T.StructField("startMs", T.LongType()), T.StructField("endMs", T.LongType())]
SILENCE = T.StructType([*INTERVAL, T.StructField("kind", T.StringType()), T.StructField("durationMs", T.LongType())])
CANDIDATE = T.StructType([*INTERVAL, T.StructField("kind", T.StringType()), T.StructField("detail", T.StringType())])
WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("startsWord", T.BooleanType()), *INTERVAL])
PROPOSAL = T.StructType([*INTERVAL, T.StructField("kind", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("literal", T.BooleanType())])
CROP = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])
SEGMENT = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("sourceId", T.StringType()), T.StructField("inMs", T.LongType()), T.StructField("outMs", T.LongType()),
        T.StructField("reason", T.StringType()), T.StructField("handlesMs", T.StructType([T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])),
        T.StructField("approval", T.StringType()), T.StructField("semanticRisk", T.StringType()), T.StructField("crop", CROP),
    ]
)
REPORT = T.StructType(
    [
        T.StructField("version", T.IntegerType()), T.StructField("durationMs", T.LongType()), T.StructField("silences", T.ArrayType(SILENCE)), T.StructField("review", T.ArrayType(CANDIDATE)),
        T.StructField("transcript", T.StructType([T.StructField("words", T.ArrayType(WORD)), T.StructField("wordLevel", T.BooleanType()), T.StructField("fragmentRatio", T.DoubleType())])),
    ]
)
EDL = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("approval", T.StringType())])
SCHEMAS = {"report": REPORT, "edl": EDL, "proposals": T.StructType([T.StructField("proposals", T.ArrayType(PROPOSAL))])}


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("source_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)(?:\.[^./]*)?$", 1))


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON documents of a fixed schema, one a file; a malformed one fails."""
    if kind not in SCHEMAS:
        raise UsageError(f"unknown document {kind!r}")
    return _named(spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "FAILFAST").json(path))


def _rows(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    return df.select("source_id", F.posexplode(column).alias("pos", "x")).select("source_id", "pos", *(F.col(f"x.{a}").alias(b) for a, b in names.items()))


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """A detect report's parts as tables; a part that is missing has no rows."""
    span = {"startMs": "start_ms", "endMs": "end_ms"}
    return {
        "lengths": reports.select("source_id", F.col("durationMs").alias("duration_ms")),
        "silences": _rows(reports, "silences", span | {"durationMs": "duration_ms"}),
        "review": _rows(reports, "review", span | {"kind": "kind", "detail": "detail"}),
        "words": _rows(reports, "transcript.words", {"text": "text", "startsWord": "starts_word"} | span),
    }


def segments_of(edls: DataFrame) -> DataFrame:
    names = {"id": "id", "sourceId": "origin", "inMs": "in_ms", "outMs": "out_ms", "reason": "reason", "approval": "approval", "semanticRisk": "semantic_risk", "crop": "crop"}
    return _rows(edls, "segments", names)


def parse_srt(files: DataFrame) -> DataFrame:
    """files(source_id, content) to cues(pos, text, starts_word, start_ms, end_ms).

    Blocks stand between blank lines; the lines after the one with the arrow are the text, joined by spaces. A
    text that begins with white space starts a word."""
    content = F.replace("content", F.lit("\r"), F.lit(""))
    blocks = files.select("source_id", F.posexplode(F.split(content, r"\n[ \t]*\n+")).alias("_n", "block"))
    lines = blocks.withColumn("lines", F.split("block", "\n"))
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->")), True)
    rows = lines.withColumn("at", at).where("at > 0").withColumn("arrow", F.element_at("lines", F.col("at").cast("int")))
    raw = F.array_join(F.slice("lines", F.col("at").cast("int") + 1, F.greatest(F.lit(0), F.size("lines") - F.col("at").cast("int"))), " ")
    times = F.split("arrow", "-->")
    rows = rows.select("source_id", "_n", raw.alias("raw"), timestamp_ms(times[0]).alias("start_ms"), timestamp_ms(times[1]).alias("end_ms"))
    pos = F.row_number().over(Window.partitionBy("source_id").orderBy("_n")) - 1
    return rows.where(F.trim("raw") != "").select("source_id", pos.alias("pos"), F.trim("raw").alias("text"), F.col("raw").rlike(r"^\s").alias("starts_word"), "start_ms", "end_ms")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(_named(spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")))


def shift_cues(cues: DataFrame, offset: Column) -> DataFrame:
    """Cues of a window in the time of their source; those without a letter or digit go."""
    return cues.where(F.col("text").rlike(r"[\p{L}\p{N}]")).withColumn("start_ms", F.col("start_ms") + offset).withColumn("end_ms", F.col("end_ms") + offset)


def read_wav(spark: SparkSession, path: str, header: int = 44) -> DataFrame:
    """(source_id, i, x): 16-bit little-endian samples as shares of full scale."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def samples(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(b[header : header + (len(b) - header) // 2 * 2], "<i2") / 32768.0)

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source_id"), "content")
    return files.select("source_id", F.posexplode(samples("content")).alias("i", "x"))


def read_manifest(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Path, length, time and content key of files; keys need the content to be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.withColumn("round", F.regexp_extract("path", r"round-(\d+)", 1).try_cast("int"))
    return out.select("path", "length", "modificationTime", "round", *([content_key(F.col("content")).alias("content_key")] if with_content else []))


def classify_reference(path: str, head: str | None = None) -> str:
    """What a reference file is: `srt` by its suffix, `edl` by a list of segments in a .json file's content, else `media`."""
    name = path.lower()
    if name.endswith(".srt"):
        return "srt"
    if name.endswith(".json"):
        try:
            doc = json.loads(head or "")
        except ValueError:
            return "media"
        if isinstance(doc, dict) and isinstance(doc.get("segments"), list):
            return "edl"
    return "media"


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, each stamped with the version."""
    df.withColumn("version", F.lit(__version__)).write.mode(mode).json(path)


def write_cache(df: DataFrame, path: str, *by: str) -> None:
    """Parquet by partition; only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_edls(edls: DataFrame, problems: DataFrame, path: str) -> None:
    """Documents, if nothing is wrong with them; the committer makes the write atomic."""
    found = problems.limit(5).collect()
    if found:
        raise RuntimeError("invalid documents: " + "; ".join(str(r.asDict()) for r in found))
    edls.write.mode("overwrite").json(path)


def report_text(summary: DataFrame) -> DataFrame:
    """One line of text for each source of series.summary."""
    kept = F.coalesce(F.try_divide(F.col("kept_ms").cast("double"), F.col("duration_ms")), F.lit(0.0))
    return summary.select("source_id", F.concat_ws(" ", F.col("source_id").cast("string"), bar(kept), duration_text(F.col("kept_ms")), F.lit("of"), duration_text(F.col("duration_ms"))).alias("line"))
