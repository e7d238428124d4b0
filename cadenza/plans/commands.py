"""The library by task: one function for each thing that a user asks for, over tables keyed by source_id.

Functions take and give DataFrames and stay lazy. `silences`, `words`, `segments` and so on have the columns that
cadenza.operators name; a UsageError means a question that makes no sense.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import jsonpath
from cadenza.functions import scalar
from cadenza.functions import text as tx
from cadenza.functions.jsonpath import UsageError
from cadenza.operators import alignment, phrases, series, timeline, validate
from cadenza.operators import intervals as iv
from cadenza.plans import build
from cadenza.sources import documents, logs

BY = ("source_id",)


def detect(lines: DataFrame, lengths: DataFrame, captions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Detector logs (and captions) to silences, candidates for review, words, statistics and drifting words."""
    silences = logs.silences(lines, lengths)
    columns = ["source_id", "start_ms", "end_ms", "kind"]
    found = [logs.blacks(lines), logs.freezes(lines), logs.clipping(lines, lengths).select(*columns)]
    review = iv.within_source(reduce(DataFrame.unionByName, [f.select(*columns) for f in found]), lengths)
    out = {"silences": silences, "review": review, "summary": series.silence_summary(silences)}
    if captions is not None:
        words = documents.parse_srt(captions)
        numbered = silences.withColumn("pos", F.col("start_ms"))
        out |= {"words": words, "transcript": series.transcript_stats(words), "drift": iv.drifting_words(words, numbered)}
    return out


def suspects(silences: DataFrame, min_ms: int = 300, ratio: float = 0.4) -> DataFrame:
    return series.pause_clusters(silences, BY, min_ms, ratio)


def edl_build(silences: DataFrame, words: DataFrame, proposals: DataFrame, lengths: DataFrame, **options) -> DataFrame:
    return build.build_edit(silences, words, proposals, lengths, **options)


def semantic_export(lines: DataFrame, segments: DataFrame, silences: DataFrame, levels: DataFrame, refs: DataFrame, min_ms: int = 600) -> dict[str, DataFrame]:
    """What a reviewer reads: surviving lines with their nearest block, repeats, silent and quiet segments."""
    kept = iv.surviving_lines(lines, segments)
    return {
        "lines": with_nearest_refs(kept, refs),
        "repeats": phrases.repeated_phrases(lines),
        "silent": iv.silent_segments(segments, silences, min_ms),
        "quiet": series.quiet_segments(levels),
    }


def with_nearest_refs(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """Lines(source_id, idx, start_ms) with `ref`, the block nearest to their start. Every line comes back once."""
    return iv.nearest_block(lines, refs, "idx", "start_ms")


def semantic_check(proposals: DataFrame, lengths: DataFrame, repeated: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The status of each source's proposals: rejected, unaddressed-repeats, valid-with-kept-repeats or valid."""
    count = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    bad = count(validate.proposal_problems(proposals.join(lengths, "source_id")).where("problem IS NOT NULL"), "rejected")
    open_ones = count(phrases.unaddressed(repeated.where("NOT discounted"), proposals), "unaddressed")
    rows = lengths.select("source_id").join(bad, "source_id", "left").join(open_ones, "source_id", "left")
    rows = rows.join(count(kept, "kept"), "source_id", "left") if kept is not None else rows.withColumn("kept", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("source_id", zero("rejected").alias("rejected"), zero("unaddressed").alias("unaddressed"), validate.check_status(zero("rejected"), zero("unaddressed"), zero("kept")).alias("status"))


def semantic_review(lines: DataFrame, cuts: DataFrame, min_ms: int = 2000) -> dict[str, DataFrame]:
    """Stretches that nobody has cut, and lines that name their own edit."""
    return {"unreviewed": iv.unreviewed(lines, cuts, min_ms), "self_edits": phrases.self_edits(lines, cuts)}


def semantic_merge(*proposals: DataFrame) -> DataFrame:
    return validate.merge_proposals(*proposals)


def explain_cuts(proposals: DataFrame, merged: DataFrame, words: DataFrame, silences: DataFrame) -> DataFrame:
    """Each proposal with the cut that it became, the text it removes, its edges in silence, drift and whether its reason fits the text."""
    own = iv.clamped_spans(proposals, merged).withColumn("start_ms", F.col("cut_start_ms")).withColumn("end_ms", F.col("cut_end_ms")).drop("cut_start_ms", "cut_end_ms")
    told = iv.drift_suspects(iv.edges_in_silence(iv.removed_text(own, words), silences), words, silences)
    return told.withColumn("reason_mismatch", tx.reason_mismatch(F.col("removed_text"), F.col("reason")))


def locate(points: DataFrame, segments: DataFrame, lengths: DataFrame, by: tuple[str, ...] = ("edl_id",)) -> DataFrame:
    return timeline.locate(points, timeline.placements(segments, by), lengths, by)


def audit(segments: DataFrame, left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("edl_id",)) -> DataFrame:
    """Envelopes of the source and the render at each segment(by, pos, i, x), correlated; low ones are suspect."""
    keys = [*by, "pos"]
    plan = series.audit_plan(timeline.placements(segments, by)).select(*keys, "window_ms")
    a = series.envelope(left, keys).select(*keys, "block", F.col("rms").alias("x"))
    b = series.envelope(right, keys).select(*keys, "block", F.col("rms").alias("y"))
    return series.audit_report(series.pearson_rows(a.join(b, [*keys, "block"]).join(plan, keys, "left_semi"), keys))


def joins(segments: DataFrame, cuts: DataFrame, words: DataFrame, heard: DataFrame | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """Joins at which speech was removed; with what is heard(by, pos, window, removed) there, how each reads."""
    out = timeline.joins(segments, cuts, words, by)
    if heard is None:
        return out
    return out.join(heard.select(*by, "pos", tx.leak_reading(F.col("window"), F.col("removed")).alias("reading")), [*by, "pos"], "left")


def say(words: DataFrame, spans: DataFrame) -> DataFrame:
    """What is said in each span(source_id, pos, start_ms, end_ms)."""
    return iv.removed_text(spans, words, separator=" ").withColumnRenamed("removed_text", "said")


def silences_of(silences: DataFrame, ranges: DataFrame) -> DataFrame:
    return iv.blocks(silences, ranges)


def converge(probes: DataFrame, phrase: str) -> DataFrame:
    """Where probes(source_id, at_ms, text) stop saying a phrase."""
    return phrases.first_clear(probes, F.lit(phrase))


def nonspeech(scores: DataFrame, heard: DataFrame) -> DataFrame:
    """Spans of low speech scores with what heard(source_id, start_ms, end_ms, text, level_db) says they are."""
    spans = logs.nonspeech_spans(scores)
    hits = iv.first_overlap(spans.withColumn("pos", F.col("start_ms")), heard)
    rows = hits.join(heard.select("source_id", F.col("start_ms").alias("r_start_ms"), "text", "level_db"), ["source_id", "r_start_ms"])
    return rows.select("source_id", "start_ms", "end_ms", tx.reading_of_nonspeech(F.col("text"), F.col("level_db")).alias("reading"))


def windows_for(lengths: DataFrame, width_ms: int = 16_000, stride_ms: int | None = None, spans: DataFrame | None = None) -> DataFrame:
    """The windows that a sweep listens to: of whole sources, or around spans; the stride is half a window unless given."""
    if width_ms <= 0 or (stride_ms is not None and stride_ms <= 0):
        raise UsageError("a window and its stride must be positive")
    stride = stride_ms or width_ms // 2
    return timeline.span_tiles(spans, lengths, width_ms, stride, BY) if spans is not None else timeline.tiles(lengths, width_ms, stride)


def verify_windows(windows: DataFrame, cached: DataFrame | None = None) -> dict[str, DataFrame]:
    """Repeats, stacked openers and restarts in windows(source_id, pos, text, lang, start_ms, end_ms), chained over overlapping windows, and odd or truncated windows."""
    keys = ["source_id", "pos"]
    found = phrases.grown_repeats(windows).where("NOT discounted").select(*keys, "phrase", "count")
    found = found.unionByName(phrases.stacked_openers(windows).select(*keys, "phrase", F.col("count").cast("long").alias("count")))
    found = found.unionByName(phrases.restarts(windows).select(*keys, "phrase", F.lit(2).cast("long").alias("count")))
    entries = found.join(windows.select(*keys, "start_ms", "end_ms"), keys)
    out = {"repeats": iv.merge_repeats(entries), "truncated": phrases.truncated_edges(windows)}
    if cached is not None:
        out |= {"anomalies": phrases.anomalies(windows, cached), "repeats": corroborate(out["repeats"], cached)}
    return out


def corroborate(repeats: DataFrame, cached: DataFrame, least: float = 0.6, bucket_ms: int = 60_000) -> DataFrame:
    """Repeats with `corroborated`, whether the cached words of the window hold enough of all words of the phrase."""
    rows = phrases.heard_share(repeats.withColumn("text", F.col("phrase")), cached, bucket_ms=bucket_ms, key="phrase", shortest=1)
    return rows.withColumn("corroborated", F.coalesce(F.col("share") >= least, F.lit(False))).drop("text", "wanted", "share")


def open_session(silences: DataFrame, lengths: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """The named speech blocks of sources, and the first of their tightest pauses."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("gap_ms", "at_ms"))
    return {"refs": iv.speech_refs(silences, lengths), "suspects": suspects(silences).withColumn("n", n).where(F.col("n") <= top).drop("n")}


def peek(points: DataFrame, words: DataFrame, heard: DataFrame, width_ms: int = 8000) -> DataFrame:
    """What the transcript and what was heard(source_id, pos, heard, all_silence) say around each point, and how they differ."""
    start, end = scalar.at_centre(F.col("at_ms"), width_ms)
    rows = say(words, points.withColumn("start_ms", start).withColumn("end_ms", end)).join(heard, ["source_id", "pos"], "left")
    return rows.withColumn("view", tx.views_disagree(F.coalesce("said", F.lit("")), F.coalesce("heard", F.lit("")), F.coalesce("all_silence", F.lit(False))))


def cut(refs: DataFrame, wanted: DataFrame, lengths: DataFrame) -> DataFrame:
    """Proposals of a hand-made cut from block names(source_id, pos, first_ref, last_ref, kind, reason), checked."""
    spans = iv.resolve_refs(wanted, refs).join(lengths, "source_id")
    return validate.proposal_problems(spans, kinds=validate.CUT_KINDS)


def auto_cut(silences: DataFrame, nonspeech_spans: DataFrame, findings: DataFrame, words: DataFrame, lengths: DataFrame) -> DataFrame:
    return build.plan_auto_cuts(silences, nonspeech_spans, phrases.repetition_cuts(findings, words).select("source_id", "pos", "start_ms", "end_ms"), words, lengths)


def dead_air(frames: DataFrame, width_s: float = 2.0) -> DataFrame:
    """The silence threshold of each source, from its floor and its median level."""
    rows = series.noise_floor(frames, BY, width_s).join(series.median_level(frames, BY, width_s), "source_id")
    return rows.withColumn("threshold_db", series.threshold(F.col("floor_db"), F.col("median_db")))


def commit(before: DataFrame, after: DataFrame, findings: DataFrame, by: tuple[str, ...] = ("edl_id",)) -> dict[str, DataFrame]:
    """What a new version must be checked for, and the findings of the last one that still stand."""
    changed = timeline.delta(before, after, by)
    places = timeline.placements(after, by)
    swept = places.join(changed.select(*by, "pos"), [*by, "pos"]).select(*by, F.col("master_in_ms").alias("start_ms"), F.col("master_out_ms").alias("end_ms"))
    return {"delta": changed, "carried": timeline.carry_forward(findings, timeline.placements(before, by), places, swept, by)}


def rounds(reports: DataFrame, cuts_before: DataFrame, cuts_after: DataFrame) -> dict[str, DataFrame]:
    return {"deltas": timeline.round_deltas(reports, BY), "cuts": alignment.diff_cuts(cuts_before, cuts_after)}


def gate(state: DataFrame) -> DataFrame:
    return build.next_step(state)


def compare(words: DataFrame, reference: DataFrame, silences: DataFrame, cuts: DataFrame, lengths: DataFrame) -> dict[str, DataFrame]:
    """What a reference version removed, how the cuts agree, and whether a verdict can be given at all."""
    recovered = alignment.recover_cuts(words, reference, silences).withColumn("pos", F.col("start_ms"))
    spoken = series.pause_total(reference).join(reference.groupBy("source_id").agg((F.max("end_ms") - F.min("start_ms")).alias("measured_ms")), "source_id")
    head = headline(recovered, cuts, lengths)
    checked = alignment.check_reference(head.select("source_id", F.col("reference_kept_ms").alias("kept_ms")).join(spoken.select("source_id", "measured_ms"), "source_id"))
    differ = alignment.compare_cuts(recovered, cuts, words).join(checked.where("withheld").select("source_id"), "source_id", "left_anti")
    return {"recovered": recovered, "headline": headline(recovered, cuts, lengths, differ), "reference": checked, "differences": differ}


def headline(recovered: DataFrame, cuts: DataFrame, lengths: DataFrame, differences: DataFrame | None = None) -> DataFrame:
    """Sums of both cut lists of each source, what each keeps of it (null if its length is unknown), and of what
    differs(source_id, verdict, start_ms, end_ms). Neither list's cuts may overlap one another."""
    total = lambda df, n, t: df.groupBy("source_id").agg(F.count("*").alias(n), F.sum(F.col("end_ms") - F.col("start_ms")).alias(t))
    rows = lengths.join(total(recovered, "recovered", "recovered_ms"), "source_id", "left").join(total(cuts, "cuts", "cut_ms"), "source_id", "left")
    rows = rows.na.fill(0, ["recovered", "recovered_ms", "cuts", "cut_ms"])
    kept, reference = F.col("duration_ms") - F.col("cut_ms"), F.col("duration_ms") - F.col("recovered_ms")
    rows = rows.withColumn("kept_ms", kept).withColumn("reference_kept_ms", reference).withColumn("kept_delta_ms", kept - reference)
    if differences is None:
        return rows
    of = lambda v: F.col("verdict") == v
    length = F.col("end_ms") - F.col("start_ms")
    told = differences.groupBy("source_id").agg(*(x for v in ("missed", "overcut") for x in (F.count_if(of(v)).alias(v), F.sum(F.when(of(v), length).otherwise(0)).alias(f"{v}_ms"))))
    return rows.join(told, "source_id", "left").na.fill(0, ["missed", "missed_ms", "overcut", "overcut_ms"])


def sessions(listing: DataFrame, older_than_days: int, now: Column) -> dict[str, DataFrame]:
    return {"health": validate.sessions_health(listing), "collect": validate.collect_reasons(listing, older_than_days, now)}


def schema(kind: str) -> str:
    """A document's schema in JSON."""
    if kind not in documents.SCHEMAS:
        raise UsageError(f"unknown document {kind!r}")
    return documents.SCHEMAS[kind].json()


def ask(docs: DataFrame, jq: str | None = None, fields: str | None = None, human: bool = False) -> DataFrame:
    """Documents through a query or a projection; only one of the two."""
    jsonpath.check_options(human, jq, fields)
    if jq:
        return jsonpath.answer(docs, jq)
    if not fields:
        return docs
    out, missing = jsonpath.project(docs, fields)
    return out.withColumn("field_errors", F.array(*(F.lit(m) for m in missing)).cast("array<string>"))
