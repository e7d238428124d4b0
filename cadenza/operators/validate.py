"""Quality gates: rules over documents that give messages, and states that follow from findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds of proposals; a cut made by hand can't be of the last kind.
PROPOSAL_KINDS = ("filler", "repetition", "false-start", "off-topic", "non-speech")
CUT_KINDS = PROPOSAL_KINDS[:-1]


def first_problem(rules: Sequence[tuple[Column, str]]) -> Column:
    """The message of the first rule that is broken; null if none is."""
    out = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), message).otherwise(out)
    return out


def proposal_problems(rows: DataFrame, duration: str = "duration_ms", kinds: Sequence[str] = PROPOSAL_KINDS) -> DataFrame:
    """rows(start_ms, end_ms, kind, reason, duration) with `problem`, the first broken rule."""
    whole = lambda c: F.col(c).isNotNull() & (F.floor(c) == F.col(c))
    rules = [
        (~whole("start_ms"), "start must be whole milliseconds"),
        (~whole("end_ms"), "end must be whole milliseconds"),
        (F.col("start_ms") < 0, "start is before 0"),
        (F.col("end_ms") <= F.col("start_ms"), "end must come after start"),
        (F.col("end_ms") > F.col(duration), "end is past the source"),
        (~F.col("kind").isin(*kinds), "unknown kind"),
        (F.trim(F.coalesce("reason", F.lit(""))) == "", "reason is empty"),
    ]
    return rows.withColumn("problem", first_problem(rules))


def _each(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """A row for each broken rule."""
    messages = F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(m)) for broken, m in rules))
    return df.select(*keys, F.explode(F.filter(messages, lambda m: m.isNotNull())).alias("problem"))


def segment_problems(segments: DataFrame, lengths: DataFrame, by: Sequence[str] = ("edl_id",)) -> DataFrame:
    """Broken rules of segments(by, pos, id, in_ms, out_ms, approval, semantic_risk, crop) of sources(by, duration_ms)."""
    rows = segments.join(lengths.select(*by, "duration_ms"), list(by), "left")
    before = F.lag("out_ms").over(Window.partitionBy(*by).orderBy("pos"))
    again = F.count("*").over(Window.partitionBy(*by, "id")) > 1
    rows = rows.withColumn("_prev", F.coalesce(before, F.lit(0))).withColumn("_again", again)
    rules = [
        (F.col("in_ms") < 0, "in is before 0"),
        (F.col("out_ms") <= F.col("in_ms"), "out must come after in"),
        (F.col("out_ms") > F.col("duration_ms"), "out is past the source"),
        (F.col("in_ms") < F.col("_prev"), "segments overlap or run backwards"),
        (F.col("_again"), "id is used twice"),
        (~F.col("approval").isin("pending", "approved", "rejected"), "unknown approval"),
        (~F.col("semantic_risk").isin("low", "material"), "unknown risk"),
        (F.col("crop").isNotNull() & ~crop_fits(F.col("crop")), "crop is outside the picture"),
    ]
    return _each(rows, [*by, "pos"], rules)


def crop_fits(crop: Column) -> Column:
    x, y, w, h = (crop[c] for c in ("x", "y", "width", "height"))
    return F.coalesce((x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1), F.lit(True))


def external_audio_problems(edls: DataFrame, sources: DataFrame, by: Sequence[str] = ("edl_id",)) -> DataFrame:
    """edls(by, external_audio_source_id) whose separate recording is none of their sources(by, id, has_audio), or has no sound.
    A document without such a name has no problem."""
    own = sources.groupBy(*by, "id").agg(F.bool_or("has_audio").alias("has_audio"))
    named = edls.where("external_audio_source_id IS NOT NULL").select(*by, F.col("external_audio_source_id").alias("id"))
    rows = named.join(own.withColumn("_known", F.lit(True)), [*by, "id"], "left")
    message = F.when(F.col("_known").isNull(), F.concat(F.lit("external audio source '"), F.col("id"), F.lit("' is not in sources")))
    message = message.when(~F.coalesce("has_audio", F.lit(False)), F.concat(F.lit("external audio source '"), F.col("id"), F.lit("' has no audio stream")))
    return rows.select(*by, message.alias("problem")).where("problem IS NOT NULL")


def source_problems(segments: DataFrame, sources: DataFrame, edls: DataFrame, by: Sequence[str] = ("edl_id",)) -> DataFrame:
    """Segments(by, pos, source, crop) whose source is unknown, lacks the picture that the document has, lacks sound that is
    required and comes from no separate recording, or that are cropped without a picture.

    sources: by, id, has_video, has_audio; edls: by, audio_required, external_audio_source_id."""
    own = sources.groupBy(*by, F.col("id").alias("source")).agg(F.bool_or("has_video").alias("has_video"), F.bool_or("has_audio").alias("has_audio"))
    picture = sources.groupBy(*by).agg(F.bool_or("has_video").alias("_picture"))
    rows = segments.join(own.withColumn("_known", F.lit(True)), [*by, "source"], "left").join(picture, list(by), "left")
    rows = rows.join(edls.select(*by, "audio_required", F.col("external_audio_source_id").isNotNull().alias("_apart")), list(by), "left")
    known, yes = F.col("_known").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [
        (~known, "unknown source"),
        (known & yes("_picture") & ~yes("has_video"), "source lacks video"),
        (known & yes("audio_required") & ~yes("_apart") & ~yes("has_audio"), "source lacks required audio"),
        (known & F.col("crop").isNotNull() & ~yes("_picture"), "crop without a picture"),
    ]
    return _each(rows, [*by, "pos"], rules)


def edl_problems(edls: DataFrame, segments: DataFrame, by: Sequence[str] = ("edl_id",), most: int = 999) -> DataFrame:
    """Documents without segments, with too many, or approved while a segment isn't."""
    n = segments.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("approval") != "approved").alias("waiting"))
    rows = edls.join(n, list(by), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rules = [(F.col("n") < 1, "no segments"), (F.col("n") > most, "too many segments"), ((F.col("approval") == "approved") & (F.coalesce("waiting", F.lit(0)) > 0), "approved with segments that are not")]
    return _each(rows, by, rules)


def output_problems(rows: DataFrame) -> DataFrame:
    """rows(expected_frames, frames, expected_ms, measured_ms, audio_ms, fps): frames off by more than one, lengths by more than two frames and 20 ms."""
    slack = 2000.0 / F.col("fps") + 20
    rules = [
        (F.abs(F.col("frames") - F.col("expected_frames")) > 1, "frame count differs"),
        (F.abs(F.col("measured_ms") - F.col("expected_ms")) > slack, "length differs"),
        (F.abs(F.col("audio_ms") - F.col("measured_ms")) > slack, "sound and picture differ"),
    ]
    return _each(rows, ["id"], rules)


def audio_problems(rows: DataFrame, tolerance_ms: int = 10) -> DataFrame:
    return _each(rows, ["id"], [(F.abs(F.col("audio_ms") - F.col("expected_ms")) > tolerance_ms, "length differs")])


def matches_render(kept_ms: Column, render_ms: Column, tolerance_ms: int = 50) -> Column:
    return F.abs(kept_ms - render_ms) <= tolerance_ms


def check_status(rejected: Column, unaddressed: Column, kept: Column) -> Column:
    return F.when(rejected > 0, "rejected").when(unaddressed > 0, "unaddressed-repeats").when(kept > 0, "valid-with-kept-repeats").otherwise("valid")


def gate_status(rounds: Column, repeats: Column, acknowledged: Column, least: int = 2) -> Column:
    """Whether a session's rounds have converged."""
    return (
        F.when((rounds < least) & ~acknowledged, "insufficient-rounds")
        .when(repeats > 0, "repeated-phrases-unresolved")
        .when(acknowledged, "acknowledged")
        .otherwise("converged-pending-review")
    )


def cache_state(size_then: Column, size_now: Column, time_then: Column, time_now: Column, key_then: Column, key_now: Column) -> Column:
    """Whether a cached result still holds: size and time first, then content."""
    return F.when((size_then == size_now) & (time_then == time_now), "match").when(key_then == key_now, "rehashed-match").otherwise("sha-changed")


def collect_reasons(sessions: DataFrame, older_than_days: int, now: Column) -> DataFrame:
    """sessions(dir, source_exists, created_at, committed_rounds, committed_at, locked) with the reasons to collect them and whether they may go."""
    age = F.floor((F.unix_seconds(now) - F.unix_seconds("created_at")) / 86400)
    named = [(~F.col("source_exists"), "orphan"), (F.col("committed_at").isNotNull(), "committed"), (age >= older_than_days, "older-than"), (F.col("locked"), "locked-protected")]
    reasons = F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in named)), lambda x: x.isNotNull())
    out = sessions.withColumn("reasons", reasons)
    return out.withColumn("deletable", ~F.col("locked") & (F.size(F.array_except("reasons", F.array(F.lit("locked-protected")))) > 0))


def sessions_health(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.count_if(~F.col("source_exists")).alias("orphans"), F.min("created_at").alias("oldest"))


def merge_proposals(*sources: DataFrame) -> DataFrame:
    """All proposals(source_id, start_ms, end_ms, kind, reason), each once where all four agree, with how often they occurred."""
    numbered = [s.withColumn("_file", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, numbered)
    return rows.groupBy("source_id", "start_ms", "end_ms", "kind", "reason").agg((F.count("*") - 1).alias("duplicates"), F.min("_file").alias("first_file"))


def match_targets(percents: DataFrame, ranges: DataFrame) -> DataFrame:
    """percents(id, percent) with the names of all target ranges(name, low, high) that hold it, ends included."""
    hits = percents.join(F.broadcast(ranges), (F.col("percent") >= F.col("low")) & (F.col("percent") <= F.col("high")), "left")
    return hits.groupBy("id", "percent").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("targets"))
