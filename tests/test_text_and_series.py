from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.functions import jsonpath, scalar
from cadenza.functions import text as tx
from cadenza.operators import alignment, phrases, series, timeline, validate
from cadenza.plans import build
from cadenza.sources import documents, logs
from tests.conftest import rows

LINE = "source_id string, idx long, lang string, text string"


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr).first()[0]


def test_pause_clusters(spark):
    schema = "source_id string, start_ms long, end_ms long"
    even = spark.createDataFrame([("a", t, t + 10) for t in range(0, 10000, 1000)], schema)
    assert series.pause_clusters(even).count() == 0
    uneven = spark.createDataFrame([("a", t, t) for t in (0, 1000, 1100, 2100, 3100)], schema)
    assert rows(series.pause_clusters(uneven), "at_ms", "gap_ms", "ratio") == [(1000, 100, 0.1)]


def test_noise_floor(spark):
    frames = spark.createDataFrame([("a", t, db) for t, db in ((0.0, -20.0), (0.5, -20.0), (2.1, -50.0), (2.6, -50.0), (4.2, -25.0), (4.7, -25.0))], "source_id string, t_s double, rms_db double")
    floor = series.noise_floor(frames).first()
    assert (round(floor["floor_db"], 6), floor["windows"]) == (-50, 3)
    silent = spark.createDataFrame([("a", float(t), float("-inf")) for t in (0, 2, 4)], "source_id string, t_s double, rms_db double")
    assert series.noise_floor(silent).first()["floor_db"] == -90


@pytest.mark.parametrize(("levels", "want"), [((-25, -26, -24, -42), [(3,)]), ((-60, -20), []), ((-25, -26, float("nan"), -42), [(3,)])])
def test_quiet_segments(spark, levels, want):
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(levels)], "source_id string, pos long, mean_db double")
    assert rows(series.quiet_segments(df), "pos") == want


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 2.0, 3.0], [3.0, 2.0, 1.0], -1), ([1.0, 2.0, 3.0], [5.0, 5.0, 5.0], 0), ([], [1.0], 0)])
def test_pearson(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(series.pearson(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["es un honor grande", "un honor grande si", "y un honor grande"], 3),
        (["un honor grande un honor grande"], 2),
        (["bueno eh eh eh eh bueno"], None),
    ],
)
def test_repeated_phrases(spark, texts, want):
    df = spark.createDataFrame([("a", i, "es", t) for i, t in enumerate(texts)], LINE)
    got = {r["phrase"]: r["count"] for r in phrases.repeated_phrases(df).collect()}
    assert got.get("un honor grande") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("para simplemente cifrar, para simplemente detectar cosas", ["para simplemente"]), ("voy a mostrar una cosa y despues voy a cerrar", []), ("la ia tendria la ia tendria acceso", ["ia tendria"])],
)
def test_restarts(spark, text, want):
    df = spark.createDataFrame([("a", 0, "es", text)], "source_id string, pos long, lang string, text string")
    assert [r["phrase"] for r in phrases.restarts(df).collect()] == want


def test_openers_and_grown_repeats(spark):
    df = spark.createDataFrame([("a", 0, "es", "Y bueno, eso es todo. Y bueno, ya para cerrar."), ("a", 1, "es", "reciben un poema mio reciben un poema mio por carta")], "source_id string, pos long, lang string, text string")
    assert rows(phrases.stacked_openers(df), "pos", "phrase", "count") == [(0, "y bueno", 2)]
    assert rows(phrases.grown_repeats(df), "pos", "phrase", "count", "discounted") == [(1, "reciben un poema mio", 2, False)]


def test_repetition_is_cut_to_the_second_reading(spark):
    words = [(w, i * 500, i * 500 + 400) for i, w in enumerate("es esta validacion es esta validacion nueva".split())]
    w = spark.createDataFrame([("a", i, t, s, e) for i, (t, s, e) in enumerate(words)], "source_id string, pos long, text string, start_ms long, end_ms long")
    f = spark.createDataFrame([("a", 0, "es esta validacion", 2, "en", 0, 9000)], "source_id string, pos long, phrase string, count long, lang string, start_ms long, end_ms long")
    assert rows(phrases.repetition_cuts(f, w), "start_ms", "end_ms", "gap_ms") == [(0, 1500, 100)]


def test_words_and_lines(spark):
    cues = spark.createDataFrame([("a", 0, "cra", True, 0, 100), ("a", 1, "fter", False, 100, 200), ("a", 2, ".", True, 200, 250), ("a", 3, " Next", True, 300, 400)], "source_id string, pos long, text string, starts_word boolean, start_ms long, end_ms long")
    words = phrases.join_words(cues)
    assert rows(words, "text", "start_ms", "end_ms") == [("Next", 300, 400), ("crafter.", 0, 250)]
    quiet = spark.createDataFrame([], "source_id string, start_ms long, end_ms long")
    assert rows(phrases.build_lines(words, quiet), "idx", "text") == [(1, "crafter."), (2, "Next")]


def _words(spark, text):
    return spark.createDataFrame([("a", i, w, i * 500, i * 500 + 400) for i, w in enumerate(text.split())], "source_id string, pos long, text string, start_ms long, end_ms long")


def test_recovery(spark):
    got = alignment.recover_cuts(_words(spark, "uno dos tres cuatro cinco seis siete ocho"), _words(spark, "uno dos siete ocho"))
    assert rows(got, "start_ms", "end_ms", "word_count", "corroborated") == [(1000, 2900, 4, True)]
    assert alignment.recover_cuts(_words(spark, "uno dos"), spark.createDataFrame([], "source_id string, pos long, text string, start_ms long, end_ms long")).count() == 0
    tags = [r["tag"] for r in alignment.opcodes(_words(spark, "a b c"), _words(spark, "a x c d")).orderBy("a_start", "b_start").collect()]
    assert tags == ["equal", "replace", "equal", "insert"]


def test_cut_diff(spark):
    schema = "source_id string, pos long, start_ms long, end_ms long, reason string"
    a = spark.createDataFrame([("a", 0, 0, 10, "x"), ("a", 1, 20, 30, "x"), ("a", 2, 40, 50, "x")], schema)
    b = spark.createDataFrame([("a", 0, 0, 10, "x"), ("a", 1, 25, 35, "x"), ("a", 2, 90, 99, "x")], schema)
    assert rows(alignment.diff_cuts(a, b), "start_ms", "status") == [(0, "unchanged"), (25, "changed"), (40, "removed"), (90, "added")]


def test_placements_and_lookups(spark):
    seg = spark.createDataFrame([(1, 1, "s", 1000, 2000), (1, 2, "s", 10000, 12000), (1, 3, "s", 19000, 20000)], "edl_id long, pos long, source_id string, in_ms long, out_ms long")
    places = timeline.placements(seg)
    assert rows(places, "master_in_ms", "master_out_ms") == [(0, 1000), (1000, 3000), (3000, 4000)]
    ask = lambda *ts: spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "edl_id long, q long, at_ms long")
    assert rows(timeline.master_to_source(ask(2000, 500, 1000, 4000), places), "q", "pos", "source_ms") == [(0, 2, 11000), (1, 1, 1500), (2, 2, 10000), (3, None, None)]
    assert rows(timeline.source_to_master(ask(11500, 5000), places), "q", "master_ms") == [(0, 2500), (1, None)]
    ends = spark.createDataFrame([(1, 20000)], "edl_id long, duration_ms long")
    assert rows(timeline.locate(ask(5000, 99999, 1500), places, ends), "q", "status", "next_pos") == [(0, "removed", 2), (1, "past-end", None), (2, "kept", None)]


def test_delta(spark):
    schema = "edl_id long, pos long, source_id string, in_ms long, out_ms long"
    before = spark.createDataFrame([(1, i, "s", i * 100, i * 100 + 50) for i in range(5)], schema)
    kept = [i for i in range(5) if i != 1]
    after = spark.createDataFrame([(1, n, "s", i * 100, i * 100 + 50) for n, i in enumerate(kept)], schema)
    assert rows(timeline.delta(before, after), "in_ms", "reason") == [(0, "neighbour-of-new-join"), (200, "neighbour-of-new-join")]


@pytest.mark.parametrize(("length", "width", "stride", "want"), [(50000, 16000, 16000, [(0, 16000), (16000, 32000), (32000, 48000), (48000, 50000)]), (20000, 10000, 5000, [(0, 10000), (5000, 15000), (10000, 20000)]), (0, 10, 5, [])])
def test_tiles(spark, length, width, stride, want):
    df = spark.createDataFrame([(1, length)], "edl_id long, duration_ms long")
    assert rows(timeline.tiles(df, width, stride), "start_ms", "end_ms") == want


def test_query_language(spark):
    doc = '{"a":[{"b":[{"c":1},{"c":2}]},{"b":[{"c":3}]}],"items":[{"n":5,"k":"x"}],"t":"5","many":[{"n":3,"k":"q"},{"n":1,"k":"r"},{"n":2,"k":"q"}]}'
    df = spark.createDataFrame([(1, doc)], "id long, doc string")
    ask = lambda q: jsonpath.answer(df, q).first()["result"]
    assert ask(".a[].b[].c") == "[1,2,3]"
    assert ask(".items[] | .n") == "5"
    assert ask(".missing") == "null"
    assert ask('.many[] | select(.k == "q" and .n >= 3) | .n') == "3"
    assert ask('.many[] | select(not(.k == "q")) | .n') == "1"
    assert ask('.many[] | select(.n > 90)') == "[]"
    assert ask(".many | sort_by(.n) | .[] | .n") == "[1,2,3]"
    assert ask('.many[] | select(.n == "3") | .n') == "[]"
    for q in (".items[] | select(.k < 5)", ".t.x", ".many.n", ".t[]"):
        with pytest.raises(Exception, match="needs numbers|cannot"):
            ask(q)
    for q in ("", ".a1", "frob(.a)", ".a |", ".a.[", "select(.a == )"):
        with pytest.raises(jsonpath.UsageError):
            jsonpath.parse(q)
    with pytest.raises(jsonpath.UsageError):
        jsonpath.check_options(jq=".", fields="a")


def test_captions_and_logs(spark):
    srt = "1\r\n00:00:01,5 --> 00:00:02,250\r\n Hello\r\nthere\r\n\r\n2\n01:02:03,456 --> 01:02:04,000\nagain\n"
    cues = documents.parse_srt(spark.createDataFrame([("a", srt)], "source_id string, content string"))
    assert rows(cues, "pos", "text", "starts_word", "start_ms", "end_ms") == [(0, "Hello there", True, 1500, 2250), (1, "again", False, 3723456, 3724000)]
    text = ["x silence_start: -0.5", "x silence_end: 1.25 | d", "silence_start: 3", "silence_start: 4", "silence_end: 4.5", "silence_start: 8"]
    log = spark.createDataFrame([("a", i, v) for i, v in enumerate(text)], "source_id string, line_no int, value string")
    ends = spark.createDataFrame([("a", 9000)], "source_id string, duration_ms long")
    assert rows(logs.silences(log, ends), "start_ms", "end_ms") == [(0, 1250), (4000, 4500), (8000, 9000)]
    assert documents.classify_reference("x.SRT") == "srt"
    assert documents.classify_reference("x.json", '{"segments": []}') == "edl"
    assert documents.classify_reference("x.json", "{") == "media"


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"version":1,"durationMs":9,"silences":[{"startMs":1,"endMs":2,"kind":"silence","durationMs":1}]}')
    tables = documents.report_tables(documents.read_documents(spark, str(tmp_path / "r.json"), "report"))
    assert rows(tables["silences"], "source_id", "start_ms") == [("r", 1)] and tables["words"].count() == 0
    (tmp_path / "s.wav").write_bytes(b"\0" * 44 + (16384).to_bytes(2, "little") + (-32768).to_bytes(2, "little", signed=True))
    assert [r["x"] for r in documents.read_wav(spark, str(tmp_path / "s.wav")).collect()] == [0.5, -1.0]
    documents.write_cache(spark.createDataFrame([("a", 1)], "source_id string, x int"), str(tmp_path / "cache"), "source_id")
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1
    with pytest.raises(RuntimeError):
        documents.write_edls(spark.range(1), spark.createDataFrame([("bad",)], "problem string"), str(tmp_path / "edl"))


def test_scalars(spark):
    assert one(spark, scalar.duration_text(F.col("x")), x=382_000) == "6m 22s"
    assert one(spark, scalar.parse_rate(F.col("x")), x="30000/1001") == pytest.approx(29.97, abs=0.01)
    assert one(spark, scalar.parse_rate(F.col("x")), x="5/0") == 0
    assert one(spark, scalar.parse_crop(F.col("x")), x="top:0.25").asDict() == {"x": 0.0, "y": 0.25, "width": 1.0, "height": 0.75}
    assert one(spark, scalar.parse_crop(F.col("x")), x="0.5,0,0.6,1") is None
    assert one(spark, scalar.parse_positions(F.col("x")), x="1, 2,x") is None
    assert one(spark, tx.fold(F.col("x")), x="Árbol à cœur") == "Arbol a cœur"
    assert one(spark, tx.slug(F.col("x")), x="  ¡Hola, Señor!  ") == "hola-senor"
    assert one(spark, tx.contains_phrase(F.col("x"), F.col("y")), x="the quick brown foxes", y="brown quick bears") is True


def test_gate_and_proposals(spark):
    assert one(spark, validate.gate_status(F.col("a"), F.col("b"), F.lit(False)), a=1, b=5) == "insufficient-rounds"
    df = spark.createDataFrame([(0, 10, "filler", "x", 100), (10, 5, "odd", "", 100), (0, 500, "filler", "x", 100)], "start_ms long, end_ms long, kind string, reason string, duration_ms long")
    assert [r["problem"] for r in validate.proposal_problems(df).orderBy("end_ms").collect()] == ["end must come after start", None, "end is past the source"]


def test_build(spark):
    span = "source_id string, pos long, start_ms long, end_ms long"
    quiet = spark.createDataFrame([("a", 0, 2000, 3000)], span)
    words = spark.createDataFrame([("a", 0, 1900, 2100)], span)
    said = spark.createDataFrame([("a", 5000, 6000, "filler", "um")], "source_id string, start_ms long, end_ms long, kind string, reason string")
    ends = spark.createDataFrame([("a", 10000)], "source_id string, duration_ms long")
    got = build.build_edit(quiet, words, said, ends, margin=0)
    assert rows(got, "in_ms", "out_ms", "semantic_risk") == [(0, 2100, "low"), (3000, 5000, "material"), (6000, 10000, "material")]
    with pytest.raises(Exception, match="invalid proposal"):
        build.build_edit(quiet, words, said.withColumn("kind", F.lit("odd")), ends).collect()


def test_surviving_repeats_against_every_place(spark):
    """Phrases are counted wherever they begin, overlaps and places across lines included."""
    texts = [("a", 0, "Ha ha ha ha! We go home."), ("a", 1, "we go home, we GO home"), ("b", 0, "we go"), ("b", 1, "home alone")]
    said = [("a", "ha ha ha", 2), ("a", "ha ha ha", 3), ("a", "we go home", 3), ("a", "we go home", 4), ("b", "we go home", 1), ("b", "go home alone", 2), ("c", "we go home", 0)]
    heard = {"a": "ha ha ha ha we go home we go home we go home", "b": "we go home alone"}
    want = []
    for source, phrase, count in said:
        n = sum(heard.get(source, "").startswith(phrase, i) for i in range(len(heard.get(source, ""))))
        if source in heard and n >= count:
            want.append((source, phrase, count, n))
    got = phrases.surviving_repeats(spark.createDataFrame(said, "source_id string, phrase string, count long"), spark.createDataFrame(texts, "source_id string, pos long, text string"))
    assert rows(got, "source_id", "phrase", "count", "heard") == sorted(want)


def test_spans_without_length_are_neither_missed_nor_overcut(spark):
    span = "source_id string, pos long, start_ms long, end_ms long"
    recovered, cuts = spark.createDataFrame([("a", 0, 500, 500), ("a", 1, 5000, 6000)], span), spark.createDataFrame([("a", 7, 2250, 2250), ("a", 8, 2000, 3000)], span)
    words = spark.createDataFrame([("a", 0, "uno", 2000, 2500)], "source_id string, pos long, text string, start_ms long, end_ms long")
    assert rows(alignment.compare_cuts(recovered, cuts, words), "verdict", "pos", "coverage") == [("missed", 1, 0.0), ("overcut", 8, 0.0)]


def test_repetition_in_one_window_of_many_findings(spark):
    said = [(w, i * 500, i * 500 + 400) for i, w in enumerate("es esta validacion es esta validacion nueva".split())]
    w = spark.createDataFrame([("a", i, t, s, e) for i, (t, s, e) in enumerate(said)], "source_id string, pos long, text string, start_ms long, end_ms long")
    finding = ("a", 0, "es esta validacion", 2, "en", 0, 9000)
    f = spark.createDataFrame([finding, finding, ("a", 0, "esta validacion nueva", 2, "en", 0, 9000), ("a", 1, "es esta validacion", 2, "en", 1500, 9000)], "source_id string, pos long, phrase string, count long, lang string, start_ms long, end_ms long")
    for bucket_ms in (700, 60_000):
        got = phrases.repetition_cuts(f, w, bucket_ms=bucket_ms)
        assert rows(got, "pos", "phrase", "start_ms", "end_ms", "gap_ms") == [(0, "es esta validacion", 0, 1500, 100)]
    # The words of a window aren't copied for each of its findings, nor sent to Python.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("SortMergeJoin") + plan.count("HashJoin") <= 2


@pytest.mark.parametrize(("text", "want"), [("uno dos tres uno dos tres", True), ("a a a a", True), ("a a a", False), ("Uno, dos. Tres UNO dos: très", True), ("uno dos tres cuatro", False), ("", False), (None, False)])
def test_windows_that_say_a_run_again(spark, text, want):
    df = spark.createDataFrame([("a", 0, "es", text)], "source_id string, pos long, lang string, text string")
    assert [r[0] or False for r in df.select(phrases.says_again(df["text"])).collect()] == [want]
    assert phrases.grown_repeats(df).count() == want
