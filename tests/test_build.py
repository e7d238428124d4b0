from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions.jsonpath import UsageError
from cadenza.operators import intervals as iv
from cadenza.operators import validate
from cadenza.plans import build
from tests.conftest import rows

SPAN = "source_id string, pos long, start_ms long, end_ms long"


def by_loops(silences, nonspeech, repetitions, words, length, budget):
    """The automatic cuts of one source, step by step."""
    cuts = []
    for s, e in nonspeech:
        if e - s >= 800:
            meet = next(((a, b) for a, b in sorted(silences) if b > s and a < e), None)
            if meet and min(e, meet[1]) - max(s, meet[0]) >= 800:
                cuts.append((max(s, meet[0]), min(e, meet[1])))
    cuts += [(s, e) for s, e in silences if e - s >= 800] + list(repetitions)

    def merged(spans):
        out = []
        for s, e in sorted(spans):
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
        return out

    once = merged(cuts)
    once = merged(once + [(a[1], b[0]) for a, b in zip(once, once[1:]) if 0 < b[0] - a[1] < 300])
    done = []
    for s, e in once:
        for a, b in sorted(words):
            if s < a < e < b and not any(x <= a < y for x, y in silences):
                e = a
        if e > s:
            done.append((s, e))
    return [] if length > 0 and sum(e - s for s, e in done) > budget * length else done


def test_automatic_cuts_against_loops(spark):
    pick = random.Random(11)
    table, want = [[], [], [], [], []], []
    for k in range(40):
        name = f"s{k}"
        spans = [[(s := pick.randint(0, 30_000), s + pick.randint(1, most)) for _ in range(n)] for n, most in ((6, 2500), (4, 3000), (3, 1500), (12, 600))]
        length = pick.choice([0, 6000, 30_000, 60_000])
        for rows_of, own in zip(table, spans, strict=False):
            rows_of += [(name, i, s, e) for i, (s, e) in enumerate(own)]
        table[4].append((name, length))
        want += [(name, s, e) for s, e in by_loops(*spans, length, 0.5)]
    frames = [spark.createDataFrame(x, SPAN) for x in table[:4]]
    got = build.plan_auto_cuts(*frames, spark.createDataFrame(table[4], "source_id string, duration_ms long"), bucket_ms=5000)
    assert rows(got, "source_id", "start_ms", "end_ms") == sorted(want)


def test_equal_cuts_count_once_and_long_ones_leave_no_fragment(spark):
    span = lambda *x: spark.createDataFrame(list(x), SPAN)
    length = spark.createDataFrame([("a", 10_000)], "source_id string, duration_ms long")
    none = spark.createDataFrame([], SPAN)
    two = build.plan_auto_cuts(span(("a", 0, 0, 4000)), none, span(("a", 0, 0, 4000)), none, length)
    assert rows(two, "start_ms", "end_ms") == [(0, 4000)]
    inside = build.plan_auto_cuts(none, none, span(("a", 0, 0, 3000), ("a", 1, 100, 900), ("a", 2, 1000, 1900)), none, length).collect()
    assert len(inside) == 1 and "fragment" not in inside[0]["reason"]


def test_segments_end_with_their_source_and_carry_the_crop(spark):
    cuts = spark.createDataFrame([("a", 2000, 3000, "silence")], "source_id string, start_ms long, end_ms long, reason string")
    length = spark.createDataFrame([("a", 10_001)], "source_id string, duration_ms long")
    # The middle of the frame nearest to the end would be 10,017.
    out = iv.invert(cuts, length, margin=0, fps=30.0, crop=F.struct(F.lit(0.25).alias("x")))
    assert rows(out, "pos", "out_ms", "crop.x") == [(1, 2017, 0.25), (2, 10_001, 0.25)]


def test_span_sources_are_read(spark, monkeypatch):
    monkeypatch.setattr(build, "SPAN_SOURCES", {})
    make = lambda kind: lambda at: spark.createDataFrame([("a", at, at + 10, kind, "x")], "source_id string, start_ms long, end_ms long, kind string, reason string")
    build.register_span_source("one", make("filler"))
    build.register_span_source("two", make("repetition"))
    assert rows(build.proposals_from(["one", "two", "one"], at=5), "start_ms", "kind", "duplicates") == [(5, "filler", 1), (5, "repetition", 0)]
    for bad in ([], ["three"]):
        with pytest.raises(UsageError):
            build.proposals_from(bad, at=5)
    with pytest.raises(UsageError):
        build.register_span_source("one", make("filler"))


def test_rules_of_sources(spark):
    sources = spark.createDataFrame([(1, "cam", True, False), (1, "mic", False, True), (2, "mic", False, True)], "edl_id long, id string, has_video boolean, has_audio boolean")
    edls = spark.createDataFrame([(1, "cam", True), (2, None, True), (3, "mic", False)], "edl_id long, external_audio_source_id string, audio_required boolean")
    assert rows(validate.external_audio_problems(edls, sources)) == [(1, "external audio source 'cam' has no audio stream"), (3, "external audio source 'mic' is not in sources")]
    segments = spark.createDataFrame([(1, 0, "cam", None), (1, 1, "mic", None), (1, 2, "gone", None), (2, 0, "mic", (0.1,))], "edl_id long, pos long, source string, crop struct<x:double>")
    assert rows(validate.source_problems(segments, sources, edls)) == [(1, 1, "source lacks video"), (1, 2, "unknown source"), (2, 0, "crop without a picture")]
