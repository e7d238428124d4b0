"""Whole pipelines over the operators: from detected silences to an edit, and from findings to automatic cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.jsonpath import UsageError
from cadenza.operators import intervals as iv
from cadenza.operators import series, timeline, validate

#: Silence thresholds in dB by preset.
PRESETS = {"gentle": -20.0, "normal": -30.0, "tight": -35.0}
SPAN_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_span_source(name: str, make: Callable[..., DataFrame]) -> None:
    """A named source of proposals: a function that gives (source_id, start_ms, end_ms, kind, reason)."""
    if name in SPAN_SOURCES:
        raise UsageError(f"{name!r} is taken")
    SPAN_SOURCES[name] = make


def proposals_from(names: list[str], **inputs: object) -> DataFrame:
    """The proposals of the named sources over their inputs, each once, with the number of times they came."""
    unknown = [n for n in names if n not in SPAN_SOURCES]
    if unknown or not names:
        raise UsageError(f"unknown span source {unknown[0]!r}" if unknown else "name a span source")
    return validate.merge_proposals(*(SPAN_SOURCES[n](**inputs) for n in names))


def build_edit(silences: DataFrame, words: DataFrame, proposals: DataFrame, lengths: DataFrame, margin: int = 100, fps: float = 0.0, min_keep: int = 300, bucket_ms: int = 60_000) -> DataFrame:
    """Silences clamped to words, joined with semantic proposals, merged and inverted to segments with their risk.

    One lazy plan, keyed by source_id throughout. Proposals that break a rule fail the build."""
    checked = validate.proposal_problems(proposals.join(lengths, "source_id"))
    good = checked.withColumn("start_ms", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("invalid proposal: "), F.col("problem"))).cast("long")).otherwise(F.col("start_ms")))
    clamped = iv.clamp_to_words(silences.select("source_id", "pos", "start_ms", "end_ms"), words.select("source_id", "start_ms", "end_ms"), min_cut=min_keep, bucket_ms=bucket_ms)
    cuts = clamped.select("source_id", "start_ms", "end_ms", F.lit("silence").alias("reason")).unionByName(good.select("source_id", "start_ms", "end_ms", F.lit("semantic").alias("reason")))
    segments = iv.invert(cuts, lengths, margin=margin, fps=fps, min_keep=min_keep)
    tolerance = margin + -(-1000 // int(fps or 30))
    return timeline.semantic_risk(segments, proposals, tolerance, ("source_id",))


def plan_auto_cuts(silences: DataFrame, nonspeech: DataFrame, repetitions: DataFrame, words: DataFrame, lengths: DataFrame, budget: float = 0.5, bucket_ms: int = 60_000) -> DataFrame:
    """The instruments' cuts, merged with their evidence, of sources whose cuts stay within the budget.

    Cuts are merged, what they leave too short to keep is cut as well, all is merged again, and ends are drawn back
    to words. Only then is the budget held against what would go; a source without a length stands.
    repetitions: source_id, pos, start_ms, end_ms."""
    columns = ["source_id", "pos", "start_ms", "end_ms", "instrument", "measurement"]
    # Of cuts with one start the instruments' order decides which is first.
    place = lambda k: F.lit(k << 40) + F.col("pos")
    breath = iv.nonspeech_cuts(nonspeech, silences, bucket_ms=bucket_ms).withColumn("pos", place(0)).withColumn("instrument", F.lit("nonspeech")).withColumn("measurement", F.format_string("%d ms without speech", F.col("end_ms") - F.col("start_ms"))).select(*columns)
    quiet = iv.silence_cuts(silences.select("source_id", "pos", "start_ms", "end_ms")).withColumn("pos", place(1)).withColumn("instrument", F.lit("silence")).select(*columns)
    said = repetitions.withColumn("pos", place(2)).withColumn("instrument", F.lit("repetition")).withColumn("measurement", F.lit("said twice")).select(*columns)
    reason = F.concat_ws(": ", "instrument", "measurement")
    before = iv.merge_auto_cuts(breath.unionByName(quiet).unionByName(said).withColumn("reason", reason)).withColumn("pos", F.lit(0).cast("long"))
    left = iv.fragments(before, words, bucket_ms=bucket_ms).withColumn("pos", F.lit(0).cast("long")).withColumn("instrument", F.lit("fragment")).withColumn("measurement", F.format_string("%d words stranded", "stranded")).withColumn("reason", reason)
    merged = iv.merge_auto_cuts(before.unionByName(left.select(*before.columns)))
    numbered = merged.withColumn("pos", F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms")).cast("long"))
    proposed = iv.snap_to_words(numbered, words, silences, bucket_ms=bucket_ms).where("end_ms > start_ms")
    over = series.stand_down(proposed, lengths.where("duration_ms > 0"), budget=budget).where("stood_down").select("source_id")
    return proposed.join(over, "source_id", "left_anti").select(*merged.columns)


def next_step(rounds: DataFrame) -> DataFrame:
    """rounds(source_id, rounds, repeats, acknowledged) with the gate's status."""
    return rounds.withColumn("status", validate.gate_status(F.col("rounds"), F.col("repeats"), F.col("acknowledged")))
