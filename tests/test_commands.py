from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.functions.jsonpath import UsageError
from cadenza.operators import intervals
from cadenza.plans import commands as cmd
from tests.conftest import rows

SPAN = "source_id string, pos long, start_ms long, end_ms long"


@pytest.fixture(scope="module")
def t(spark):
    words = "hello there my friend how are you today".split()
    make = lambda df, schema: spark.createDataFrame(df, schema)
    return {
        "silences": make([("a", 0, 2000, 3000), ("a", 1, 5000, 5900), ("a", 2, 6000, 7000), ("a", 3, 9000, 9500)], SPAN),
        "words": make([("a", i, w, i * 500, i * 500 + 400) for i, w in enumerate(words)], "source_id string, pos long, text string, start_ms long, end_ms long"),
        "lengths": make([("a", 10000)], "source_id string, duration_ms long"),
        "proposals": make([("a", 0, 500, 1500, "filler", "hello there")], SPAN + ", kind string, reason string"),
        "lines": make([("a", 0, "en", "scratch that one", 0, 900), ("a", 1, "en", "one two three one two three", 4000, 4900)], "source_id string, idx long, lang string, text string, start_ms long, end_ms long"),
    }


def test_detect(spark):
    log = spark.createDataFrame([("a", i, v) for i, v in enumerate(["silence_start: 1", "silence_end: 2", "black_start:3 black_end:4", "Peak level dB: -0.5"])], "source_id string, line_no int, value string")
    ends = spark.createDataFrame([("a", 10000)], "source_id string, duration_ms long")
    srt = spark.createDataFrame([("a", "1\n0:0:1,5 --> 0:0:2,0\nhi\n")], "source_id string, content string")
    out = cmd.detect(log, ends, srt)
    assert rows(out["review"], "kind") == [("black",), ("clipping",)]
    assert rows(out["drift"], "drift_ms") == [(500,)] and out["words"].count() == 1


def test_review(spark, t):
    merged = spark.createDataFrame([("a", 400, 1600)], "source_id string, start_ms long, end_ms long")
    told = cmd.explain_cuts(t["proposals"], merged, t["words"], t["silences"]).first()
    assert (told["start_ms"], told["end_ms"], told["start_in_silence"]) == (400, 1600, False)
    status = cmd.semantic_check(t["proposals"], t["lengths"], cmd.phrases.repeated_phrases(t["lines"])).first()
    assert status["status"] == "unaddressed-repeats"
    assert rows(cmd.semantic_review(t["lines"], merged)["self_edits"], "idx") == [(0,)]
    assert cmd.semantic_merge(t["proposals"].drop("pos"), t["proposals"].drop("pos")).first()["duplicates"] == 1


def test_open_peek_cut(spark, t):
    session = cmd.open_session(t["silences"], t["lengths"])
    assert rows(session["refs"], "ref", "start_ms")[:2] == [("b1", 0), ("b2", 3000)]
    points = spark.createDataFrame([("a", 0, 500)], "source_id string, pos long, at_ms long")
    heard = spark.createDataFrame([("a", 0, "hello there", False)], "source_id string, pos long, heard string, all_silence boolean")
    assert cmd.peek(points, t["words"], heard, 1000).first()["view"] == "aligned"
    wanted = spark.createDataFrame([("a", 0, "b1", "b2", "non-speech", "x")], "source_id string, pos long, first_ref string, last_ref string, kind string, reason string")
    assert cmd.cut(session["refs"], wanted, t["lengths"]).first()["problem"] == "unknown kind"


def test_compare_and_verify(spark, t):
    reference = t["words"].where("pos NOT IN (2, 3)")
    out = cmd.compare(t["words"], reference, t["silences"].where("false"), t["proposals"], t["lengths"])
    assert rows(out["recovered"], "start_ms", "end_ms") == [(1000, 1900)]
    assert out["headline"].first()["reference_kept_ms"] == 9100 and out["reference"].first()["withheld"]
    windows = spark.createDataFrame([("a", 0, "we love small rockets we love small rockets and", "en", 0, 9000)], "source_id string, pos long, text string, lang string, start_ms long, end_ms long")
    found = cmd.verify_windows(windows, t["words"])
    # The sweep hears the phrase twice, and the second word as a restart too.
    assert rows(found["repeats"], "phrase", "count", "corroborated") == [("love small rockets", 2, False), ("we love small rockets", 2, False)]
    assert found["truncated"].count() == 1 and found["anomalies"].count() == 1


def test_versions(spark):
    schema = "edl_id long, pos long, source_id string, in_ms long, out_ms long"
    before = spark.createDataFrame([(1, i, "s", i * 100_000, i * 100_000 + 50_000) for i in range(4)], schema)
    after = before.where("pos != 1").withColumn("pos", F.when(F.col("pos") > 1, F.col("pos") - 1).otherwise(F.col("pos")))
    findings = spark.createDataFrame([(1, 0, 60_000, 500), (1, 1, 190_000, 500)], "edl_id long, q long, at_ms long, width_ms long")
    out = cmd.commit(before, after, findings)
    assert rows(out["delta"], "pos") == [(0,), (1,)]
    assert rows(out["carried"], "q", "start_ms") == [(1, 140_000)]


def test_questions(spark):
    with pytest.raises(UsageError):
        cmd.windows_for(spark.range(1), 0)
    with pytest.raises(UsageError):
        cmd.schema("nothing")
    with pytest.raises(UsageError):
        cmd.ask(spark.range(1), jq=".", fields="a")
    assert cmd.ask(spark.range(1), fields="id,x").first().asDict() == {"id": 0, "field_errors": ["x"]}
    assert "durationMs" in cmd.schema("report")


def test_lines_after_a_silence_without_length_get_the_later_block(spark):
    span = "source_id string, pos long, start_ms long, end_ms long"
    refs = intervals.speech_refs(spark.createDataFrame([("a", 0, 6000, 6000)], span), spark.createDataFrame([("a", 10000)], "source_id string, duration_ms long"))
    said = spark.createDataFrame([("a", 0, 5000, 5500, "uno"), ("a", 1, 6000, 6500, "dos"), ("a", 2, 7000, 7500, "tres")], "source_id string, idx long, start_ms long, end_ms long, text string")
    assert rows(cmd.with_nearest_refs(said, refs), "idx", "ref") == [(0, "b1"), (1, "b2"), (2, "b2")]


def test_lines_come_back_once_with_their_own_block(spark):
    refs = spark.createDataFrame([("a", "b1", 0, 1000), ("a", "b2", 2000, 3000)], "source_id string, ref string, start_ms long, end_ms long")
    said = spark.createDataFrame([("a", 4, 500, 600, "uno"), ("a", 4, 2100, 2200, "dos"), ("a", None, 900, 950, "tres"), (None, 5, 900, 950, "cuatro")], "source_id string, idx long, start_ms long, end_ms long, text string")
    assert rows(cmd.with_nearest_refs(said, refs), "text", "ref") == [("cuatro", None), ("dos", "b2"), ("tres", "b1"), ("uno", "b1")]
