"""Coordinates of edits: placements, look-ups between source and master, and changes between versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.intervals import interval_join, points_in

BY = ("edl_id",)


def placements(segments: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """segments(by, pos, source_id, in_ms, out_ms) with where they stand in the master, in the order of pos."""
    length = F.col("out_ms") - F.col("in_ms")
    before = F.coalesce(F.sum(length).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("master_in_ms", before).withColumn("master_out_ms", F.col("master_in_ms") + length)


def _spans(places: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    return places.select(*by, F.col(start).alias("start_ms"), F.col(end).alias("end_ms"), "pos", "in_ms", "master_in_ms")


def _first(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(F.min(F.struct("r_pos", "r_in_ms", "r_master_in_ms", "r_start_ms")).alias("x"))


def master_to_source(points: DataFrame, places: DataFrame, by: Sequence[str] = BY, id_col: str = "q", bucket_ms: int = 60_000) -> DataFrame:
    """points(by, id, at_ms) in the master to segment and source_ms; null past the end."""
    hits = points_in(points, _spans(places, by, "master_in_ms", "master_out_ms"), "at_ms", by, bucket_ms)
    out = points.join(_first(hits, [*by, id_col]), [*by, id_col], "left")
    return out.withColumn("pos", F.col("x.r_pos")).withColumn("source_ms", F.col("at_ms") - F.col("x.r_master_in_ms") + F.col("x.r_in_ms")).drop("x")


def source_to_master(points: DataFrame, places: DataFrame, by: Sequence[str] = BY, id_col: str = "q", bucket_ms: int = 60_000) -> DataFrame:
    """points(by, id, at_ms) in the source to segment and master_ms; null where it was removed."""
    hits = points_in(points, _spans(places, by, "in_ms", "out_ms"), "at_ms", by, bucket_ms)
    out = points.join(_first(hits, [*by, id_col]), [*by, id_col], "left")
    return out.withColumn("pos", F.col("x.r_pos")).withColumn("master_ms", F.col("at_ms") - F.col("x.r_in_ms") + F.col("x.r_master_in_ms")).drop("x")


def neighbours(places: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The segments before and after each, and the time cut before it if both are of one source."""
    order = Window.partitionBy(*by).orderBy("pos")
    cut = F.when(F.lag("source_id").over(order) == F.col("source_id"), F.col("in_ms") - F.lag("out_ms").over(order))
    return places.withColumn("prev_pos", F.lag("pos").over(order)).withColumn("next_pos", F.lead("pos").over(order)).withColumn("cut_before_ms", cut)


def locate(points: DataFrame, places: DataFrame, lengths: DataFrame, by: Sequence[str] = BY, id_col: str = "q", bucket_ms: int = 60_000) -> DataFrame:
    """Source points to `kept` (with master_ms), `removed` (with the first segment that begins at or after) or `past-end`.

    The next surviving segment is found in one ordered pass over points and segments."""
    found = source_to_master(points, places, by, id_col, bucket_ms).join(lengths.select(*by, "duration_ms"), list(by), "left")
    p = points.select(*by, F.col("at_ms").alias("t"), F.lit(0).alias("kind"), F.col(id_col).alias("_q"), F.lit(None).cast("struct<pos:bigint,at:bigint>").alias("s"))
    s = places.select(*by, F.col("in_ms").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(points.schema[id_col].dataType).alias("_q"), F.struct(F.col("pos").cast("long").alias("pos"), F.col("in_ms").cast("long").alias("at")).alias("s"))
    after = Window.partitionBy(*by).orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing)
    # The first segment in the order of the edit among those that begin at or after the point.
    rows = p.unionByName(s).withColumn("n", F.min("s").over(after)).where("kind = 0").select(*by, F.col("_q").alias(id_col), F.col("n.pos").alias("next_pos"))
    out = found.join(rows, [*by, id_col], "left")
    status = F.when(F.col("at_ms") >= F.col("duration_ms"), "past-end").when(F.col("master_ms").isNull(), "removed").otherwise("kept")
    return out.withColumn("status", status).withColumn("next_pos", F.when(status == "removed", F.col("next_pos")))


def relocate(points: DataFrame, before: DataFrame, after: DataFrame, by: Sequence[str] = BY, id_col: str = "q", bucket_ms: int = 60_000) -> DataFrame:
    """Points of one version's master in another's; null where they were removed."""
    source = master_to_source(points, before, by, id_col, bucket_ms).select(*by, id_col, F.col("at_ms").alias("old_ms"), F.col("source_ms").alias("at_ms"))
    out = source_to_master(source.where("at_ms IS NOT NULL"), after, by, id_col, bucket_ms).select(*by, id_col, F.col("master_ms").alias("new_ms"))
    return source.select(*by, id_col, "old_ms").join(out, [*by, id_col], "left")


def project_cuts(cuts: DataFrame, places: DataFrame, by: Sequence[str] = BY, bucket_ms: int = 60_000) -> DataFrame:
    """Master cuts(by, pos, start_ms, end_ms) in the source: a row for each segment that a cut meets."""
    right = _spans(places, by, "master_in_ms", "master_out_ms").withColumnRenamed("pos", "seg_pos")
    pairs = interval_join(cuts, right, by, bucket_ms)
    shift = F.col("r_in_ms") - F.col("r_master_in_ms")
    return pairs.select(*by, "pos", F.col("r_seg_pos").alias("seg_pos"), (F.greatest("start_ms", "r_start_ms") + shift).alias("start_ms"), (F.least("end_ms", "r_end_ms") + shift).alias("end_ms"))


def boundaries_after_speech(segments: DataFrame, cuts: DataFrame, words: DataFrame, by: Sequence[str] = BY, bucket_ms: int = 60_000) -> DataFrame:
    """Segments after the first with a gap before them that a speech cut overlaps: pos, in_ms, cut_ms, words_removed."""
    before = F.lag("out_ms").over(Window.partitionBy(*by).orderBy("pos"))
    gaps = segments.withColumn("_prev", before).where("in_ms > _prev").select(*by, "pos", F.col("_prev").alias("start_ms"), F.col("in_ms").alias("end_ms"))
    hit = interval_join(gaps, cuts.select(*by, "start_ms", "end_ms"), by, bucket_ms).select(*by, "pos").distinct()
    rows = gaps.join(hit, [*by, "pos"], "left_semi")
    said = interval_join(rows, words.select(*by, "start_ms", "end_ms"), by, bucket_ms).groupBy(*by, "pos").agg(F.count("*").alias("words_removed"))
    out = rows.join(said, [*by, "pos"], "left")
    return out.select(*by, "pos", F.col("end_ms").alias("in_ms"), (F.col("end_ms") - F.col("start_ms")).alias("cut_ms"), F.coalesce("words_removed", F.lit(0)).alias("words_removed"))


def joins(segments: DataFrame, cuts: DataFrame, words: DataFrame, by: Sequence[str] = BY, bucket_ms: int = 60_000) -> DataFrame:
    """Joins in the master that speech was removed at, with the first cut that owns them."""
    at = boundaries_after_speech(segments, cuts, words, by, bucket_ms)
    places = placements(segments, by).select(*by, "pos", "master_in_ms")
    gaps = at.select(*by, "pos", (F.col("in_ms") - F.col("cut_ms")).alias("start_ms"), F.col("in_ms").alias("end_ms"))
    owner = interval_join(gaps, cuts.select(*by, F.col("pos").alias("cut_pos"), "start_ms", "end_ms"), by, bucket_ms).groupBy(*by, "pos").agg(F.min("r_cut_pos").alias("cut_pos"))
    return at.join(places, [*by, "pos"]).join(owner, [*by, "pos"], "left")


def match_reports(cuts: DataFrame, reports: DataFrame, tolerance: int = 50, by: Sequence[str] = BY) -> DataFrame:
    """The report of each cut: of the same edges, else the first with both edges nearer than the tolerance."""
    r = reports.select(*by, F.col("pos").alias("report_pos"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"))
    # Starts nearer than the tolerance fall into the same or a neighbouring bucket of that width.
    near = r.withColumn("_b", F.explode(F.array(*(F.floor(F.col("rs") / tolerance) + i for i in (-1, 0, 1)))))
    pairs = cuts.withColumn("_b", F.floor(F.col("start_ms") / tolerance)).join(near, [*by, "_b"])
    off = (F.abs(F.col("rs") - F.col("start_ms")) < tolerance) & (F.abs(F.col("re") - F.col("end_ms")) < tolerance)
    exact = (F.col("rs") == F.col("start_ms")) & (F.col("re") == F.col("end_ms"))
    best = pairs.where(off).groupBy(*by, "pos").agg(F.min(F.struct((~exact).alias("inexact"), "report_pos")).alias("x"))
    return cuts.join(best.select(*by, "pos", "x.report_pos", (~F.col("x.inexact")).alias("exact")), [*by, "pos"], "left")


def semantic_risk(segments: DataFrame, proposals: DataFrame, tolerance: int, by: Sequence[str] = BY) -> DataFrame:
    """segments with `material` where an edge of a proposal comes within the tolerance of an edge of theirs, else `low`."""
    edges = proposals.select(*by, F.explode(F.array("start_ms", "end_ms")).alias("edge")).distinct()
    width = max(1, tolerance)
    edges = edges.withColumn("_b", F.explode(F.array(*(F.floor(F.col("edge") / width) + i for i in (-1, 0, 1)))))
    own = segments.select(*by, "pos", F.explode(F.array("in_ms", "out_ms")).alias("at")).withColumn("_b", F.floor(F.col("at") / width))
    hit = own.join(edges, [*by, "_b"]).where(F.abs(F.col("at") - F.col("edge")) <= tolerance).select(*by, "pos").distinct()
    return segments.join(hit.withColumn("_hit", F.lit(True)), [*by, "pos"], "left").withColumn("semantic_risk", F.when(F.col("_hit"), "material").otherwise("low")).drop("_hit")


def content_changed(before: DataFrame, after: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Segments of `after` whose (source_id, in_ms, out_ms) isn't in `before`."""
    return after.join(before.select(*by, "source_id", "in_ms", "out_ms").distinct(), [*by, "source_id", "in_ms", "out_ms"], "left_anti")


def closed_gaps(before: DataFrame, after: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Pairs of neighbours in `after` between which segments of `before` were removed: (by, left_pos, right_pos).

    A segment that occurs twice counts where it is last."""
    key = ["source_id", "in_ms", "out_ms"]
    to = after.groupBy(*by, *key).agg(F.max("pos").alias("to_pos"))
    kept = before.join(to, [*by, *key])
    order = Window.partitionBy(*by).orderBy("pos")
    rows = kept.withColumn("_from", F.lag("pos").over(order)).withColumn("_to", F.lag("to_pos").over(order))
    return rows.where("pos - _from > 1 AND to_pos - _to = 1").select(*by, F.col("_to").alias("left_pos"), F.col("to_pos").alias("right_pos"))


def delta(before: DataFrame, after: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Segments of `after` to check again: changed ones, their neighbours, and both sides of a closed gap. pos counts up by one."""
    changed = content_changed(before, after, by).select(*by, "pos").withColumn("rank", F.lit(0))
    near = changed.select(*by, F.explode(F.array(F.col("pos") - 1, F.col("pos") + 1)).alias("pos"))
    gap = closed_gaps(before, after, by)
    sides = gap.select(*by, F.explode(F.array("left_pos", "right_pos")).alias("pos"))
    rows = changed.unionByName(near.unionByName(sides).withColumn("rank", F.lit(1)))
    reason = F.when(F.min("rank") == 0, "content-changed").otherwise("neighbour-of-new-join")
    return after.join(rows.groupBy(*by, "pos").agg(reason.alias("reason")), [*by, "pos"])


def carry_forward(findings: DataFrame, before: DataFrame, after: DataFrame, swept: DataFrame, by: Sequence[str] = BY, reach_ms: int = 16_000, bucket_ms: int = 60_000) -> DataFrame:
    """Findings(by, q, at_ms, width_ms) of one version in the next: gone where removed or within reach of what was swept anew, else moved."""
    moved = relocate(findings.select(*by, "q", "at_ms"), before, after, by, "q", bucket_ms).where("new_ms IS NOT NULL")
    wide = swept.select(*by, (F.col("start_ms") - reach_ms).alias("start_ms"), (F.col("end_ms") + reach_ms).alias("end_ms"))
    seen = points_in(moved, wide, "new_ms", by, bucket_ms).select(*by, "q").distinct()
    out = moved.join(seen, [*by, "q"], "left_anti").join(findings.select(*by, "q", "width_ms"), [*by, "q"])
    return out.select(*by, "q", "old_ms", F.col("new_ms").alias("start_ms"), (F.col("new_ms") + F.col("width_ms")).alias("end_ms"))


def finding_diff(before: DataFrame, after: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Findings(by, start_ms, end_ms, text) that stand in both versions, were addressed, or are new."""
    key = [*by, "start_ms", "end_ms", "text"]
    a, b = before.select(*key).distinct().withColumn("_a", F.lit(True)), after.select(*key).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a") & F.col("_b"), "standing").when(F.col("_a"), "addressed").otherwise("new")
    return a.join(b, key, "full").withColumn("status", status).drop("_a", "_b")


def round_deltas(reports: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each round's change of removal_percent and segments against the round before."""
    order = Window.partitionBy(*by).orderBy("round")
    return reports.withColumn("removal_delta", F.round(F.col("removal_percent") - F.lag("removal_percent").over(order), 2)).withColumn("segments_delta", F.col("segments") - F.lag("segments").over(order))


def tiles(lengths: DataFrame, width: int, stride: int | None = None, length: str = "duration_ms") -> DataFrame:
    """Windows of `width` every `stride` up to the first that reaches the end, which ends there."""
    stride = stride or width
    if width <= 0 or stride <= 0:
        return lengths.withColumn("start_ms", F.lit(None).cast("long")).withColumn("end_ms", F.lit(None).cast("long")).where("false")
    rows = lengths.where(F.col(length) > 0).withColumn("start_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length) - 1, F.lit(stride).cast("long"))))
    return rows.where((F.col("start_ms") == 0) | (F.col("start_ms") - stride + width < F.col(length))).withColumn("end_ms", F.least(F.col("start_ms") + width, F.col(length)))


def span_tiles(spans: DataFrame, lengths: DataFrame, width: int, stride: int, by: Sequence[str] = BY) -> DataFrame:
    """Tiles of spans widened by `width` on both sides, each once."""
    wide = spans.join(lengths.select(*by, "duration_ms"), list(by)).select(*by, F.greatest(F.lit(0), F.col("start_ms") - width).alias("_from"), F.least(F.col("end_ms") + width, F.col("duration_ms")).alias("_to"))
    inner = tiles(wide.withColumn("_len", F.col("_to") - F.col("_from")), width, stride, "_len")
    return inner.select(*by, (F.col("_from") + F.col("start_ms")).alias("start_ms"), (F.col("_from") + F.col("end_ms")).alias("end_ms")).distinct()


def chunks(duration_ms: Column, chunk_ms: int) -> Column:
    """How many pieces a recording is read in; one at least."""
    return F.greatest(F.lit(1), F.ceil(duration_ms / chunk_ms)).cast("long")
