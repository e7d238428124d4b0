"""Registered queries of reports, sessions, document rules and the query language's edges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import jsonpath, scalar
from cadenza.operators import intervals as iv
from cadenza.operators import validate
from cadenza.plans import commands
from cadenza.plans import interval_queries as iq
from cadenza.plans import text_queries as tq
from cadenza.plans.tables import EVENTS_SQL, MONTH_MS, ORIGIN_MS, SEGMENTS_SQL, lengths, segments, spans, table, turns
from cadenza.streaming import windows

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, sql: str, *ctes: str):
    def register(f):
        QUERIES[name] = f
        ORACLES[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return register


def _sums(name: str, table_: str) -> str:
    return f"{name} AS (SELECT source_id, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM {table_} GROUP BY source_id)"


@_add("headline", f"""SELECT source_id, {MONTH_MS} AS duration_ms, coalesce(a.n, 0) AS recovered, coalesce(a.ms, 0) AS recovered_ms, coalesce(b.n, 0) AS cuts, coalesce(b.ms, 0) AS cut_ms, {MONTH_MS} - coalesce(b.ms, 0) AS kept_ms, {MONTH_MS} - coalesce(a.ms, 0) AS reference_kept_ms, coalesce(a.ms, 0) - coalesce(b.ms, 0) AS kept_delta_ms,
coalesce(c.n, 0) AS missed, coalesce(c.ms, 0) AS missed_ms, coalesce(e.n, 0) AS overcut, coalesce(e.ms, 0) AS overcut_ms FROM lengths LEFT JOIN a USING (source_id) LEFT JOIN b USING (source_id) LEFT JOIN c USING (source_id) LEFT JOIN e USING (source_id)""", EVENTS_SQL, iq.QUIET, iq.MERGED, _sums("a", "quiet"), _sums("b", "merged"), _sums("c", "proposals"), _sums("e", "others"))
def headline(s: SparkSession, d: str) -> DataFrame:
    """Silences stand for what a reference removed, proposals and others for what differs."""
    differ = spans(s, d, "proposals").withColumn("verdict", F.lit("missed")).unionByName(spans(s, d, "others").withColumn("verdict", F.lit("overcut")))
    return commands.headline(iv.merge(spans(s, d, "silences")), iv.merge(spans(s, d, "cuts")), lengths(s, d), differ)


@_add("corroborated_repeats", f"""SELECT source_id, pos, phrase, count(*) FILTER (list_contains(heard, word)) / count(*) >= 0.6 AS corroborated FROM (SELECT w.source_id, w.pos, w.phrase, unnest({tq.words_of(tq.n2('w.phrase'))}) AS word, coalesce(h.heard, []) AS heard FROM said w
LEFT JOIN (SELECT a.source_id, a.pos, list(u.w) AS heard FROM said a JOIN (SELECT source_id, start_ms - 10000 AS s, end_ms AS e, unnest({tq.words_of(tq.n2('text'))}) AS w FROM turns WHERE role = 'user') u ON u.source_id = a.source_id AND u.e > a.start_ms AND u.s < a.end_ms GROUP BY a.source_id, a.pos) h ON h.source_id = w.source_id AND h.pos = w.pos) GROUP BY source_id, pos, phrase""", tq.TURNS, "said AS (SELECT source_id, pos, text AS phrase, start_ms, end_ms FROM turns WHERE role = 'assistant')")
def corroborated_repeats(s: SparkSession, d: str) -> DataFrame:
    """What the assistant says, against what users say from one turn before on."""
    rows = turns(s, d)
    cached = rows.where("role = 'user'").withColumn("start_ms", F.col("start_ms") - 10000)
    return commands.corroborate(rows.where("role = 'assistant'").select("source_id", "pos", F.col("text").alias("phrase"), "start_ms", "end_ms"), cached).select("source_id", "pos", "phrase", "corroborated")


@_add("lines_with_refs", """SELECT w.source_id, w.pos AS idx, w.text, r.ref FROM words w LEFT JOIN refs r ON r.source_id = w.source_id QUALIFY row_number() OVER (PARTITION BY w.source_id, w.pos ORDER BY
CASE WHEN r.start_ms <= w.start_ms AND w.start_ms < r.end_ms THEN 0 ELSE 1 END, least(abs(w.start_ms - r.start_ms), abs(w.start_ms - r.end_ms)), r.start_ms) = 1""", EVENTS_SQL, iq.QUIET, iq.REFS)
def lines_with_refs(s: SparkSession, d: str) -> DataFrame:
    rows = spans(s, d, "words").withColumnRenamed("pos", "idx")
    return commands.with_nearest_refs(rows, iv.speech_refs(spans(s, d, "silences"), lengths(s, d))).select("source_id", "idx", "text", "ref")


@_add("point_sessions", f"""SELECT source_id, min(start_ms) AS start_ms, max(start_ms) + 7200000 AS end_ms, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY start_ms, pos ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms, pos) <= 7200000 THEN 0 ELSE 1 END AS fresh FROM ev)) GROUP BY source_id, island""", EVENTS_SQL)
def point_sessions(s: SparkSession, d: str) -> DataFrame:
    points = spans(s, d).select("source_id", F.timestamp_millis(F.col("start_ms") + ORIGIN_MS).alias("ts"))
    out = windows.point_sessions(points, "2 hours", "1 day", "source_id")
    return out.select("source_id", *((F.unix_millis(c) - ORIGIN_MS).alias(f"{c}_ms") for c in ("start", "end")), "n")


@_add("expected_frames_plain", "SELECT edl_id, CAST(floor(sum(out_ms - in_ms) / 1000.0 * 29.97 + 0.5) AS BIGINT) AS frames FROM seg GROUP BY edl_id", SEGMENTS_SQL)
def expected_frames_plain(s: SparkSession, d: str) -> DataFrame:
    total = segments(s, d).groupBy("edl_id").agg(F.sum(F.col("out_ms") - F.col("in_ms")).alias("ms"))
    return total.select("edl_id", scalar.expected_frames_plain(F.col("ms"), F.lit(29.97)).alias("frames"))


EDLS = """edls AS (SELECT o_orderkey AS edl_id, CASE WHEN o_orderstatus <> 'F' THEN 's' || (o_orderkey % 4) END AS outside, o_orderpriority LIKE '1%' AS audio_required FROM orders),
srcs AS (SELECT DISTINCT l_orderkey AS edl_id, 's' || (l_suppkey % 3) AS id, l_suppkey % 3 <> 1 AND l_orderkey % 5 > 0 AS has_video, l_suppkey % 3 = 1 AS has_audio FROM lineitem)"""


def _edls(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, p = F.col("l_orderkey"), F.col("l_suppkey") % 3
    named = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string")))
    edls = table(s, d, "orders").select(F.col("o_orderkey").alias("edl_id"), named.alias("external_audio_source_id"), F.col("o_orderpriority").startswith("1").alias("audio_required"))
    sources = table(s, d, "lineitem").select(k.alias("edl_id"), F.concat(F.lit("s"), p.cast("string")).alias("id"), ((p != 1) & (k % 5 > 0)).alias("has_video"), (p == 1).alias("has_audio"))
    return edls, sources


@_add("external_audio_issues", "SELECT e.edl_id, 'external audio source ''' || outside || CASE WHEN x.id IS NULL THEN ''' is not in sources' ELSE ''' has no audio stream' END AS problem FROM edls e LEFT JOIN srcs x ON x.edl_id = e.edl_id AND x.id = outside WHERE outside IS NOT NULL AND NOT coalesce(x.has_audio, false)", EDLS)
def external_audio_issues(s: SparkSession, d: str) -> DataFrame:
    return validate.external_audio_problems(*_edls(s, d))


@_add("source_issues", """SELECT edl_id, pos, problem FROM (SELECT g.edl_id, g.pos, x.id IS NOT NULL AS known, coalesce(x.has_video, false) AS v, coalesce(x.has_audio, false) AS a, coalesce(v.v, false) AS picture, e.audio_required AND e.outside IS NULL AS owed, g.pos % 3 = 0 AS crop FROM seg g JOIN edls e USING (edl_id) LEFT JOIN srcs x ON x.edl_id = g.edl_id AND x.id = 's' || ((g.source_id + CAST(g.pos = 5 AS INTEGER)) % 4) LEFT JOIN (SELECT edl_id, bool_or(has_video) AS v FROM srcs GROUP BY edl_id) v ON v.edl_id = g.edl_id),
LATERAL (SELECT unnest([CASE WHEN NOT known THEN 'unknown source' END, CASE WHEN known AND picture AND NOT v THEN 'source lacks video' END, CASE WHEN known AND owed AND NOT a THEN 'source lacks required audio' END, CASE WHEN known AND crop AND NOT picture THEN 'crop without a picture' END]) AS problem) WHERE problem IS NOT NULL""", SEGMENTS_SQL, EDLS)
def source_issues(s: SparkSession, d: str) -> DataFrame:
    edls, sources = _edls(s, d)
    other = (F.col("source_id") + (F.col("pos") == 5).cast("int")) % 4
    crop = F.when(F.col("pos") % 3 == 0, F.struct(F.lit(0.1).alias("x")))
    rows = segments(s, d).select("edl_id", "pos", F.concat(F.lit("s"), other.cast("string")).alias("source"), crop.alias("crop"))
    return validate.source_problems(rows, sources, edls)


@_add("next_generation", "SELECT o_custkey, p AS preset, CASE WHEN max(g) FILTER (preset = p) IS NOT NULL THEN CAST(max(g) FILTER (preset = p) AS INTEGER) ELSE CAST(count(*) + 1 AS INTEGER) END AS generation FROM (SELECT o_custkey, o_orderpriority AS preset, count(*) AS g FROM orders GROUP BY ALL), (VALUES ('1-URGENT'), ('5-LOW'), ('other')) v(p) GROUP BY o_custkey, p")
def next_generation(s: SparkSession, d: str) -> DataFrame:
    """Each customer's orders by priority as the generations of presets that it has."""
    n = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").cast("int").alias("g"))
    maps = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "g"))).alias("gens"))
    rows = maps.select("o_custkey", "gens", F.explode(F.array(*(F.lit(p) for p in ("1-URGENT", "5-LOW", "other")))).alias("preset"))
    return rows.select("o_custkey", "preset", scalar.next_generation(F.col("gens"), F.col("preset")).alias("generation"))


@_add("json_identity", """SELECT o_orderkey AS id, '{"k":' || o_custkey || ',"s":"' || o_orderstatus || '"}' AS result FROM orders""")
def json_identity(s: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")))
    return jsonpath.answer(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), doc.alias("doc")), ".")


#: Questions, and whether they make sense.
QUESTIONS = {
    ".": True, ".a.b": True, ".a[].b[]": True, ".a1": False, ".a..b": False, "a": False, r'.a | select(.b == "x\"y")': True, ".a | select(.b[] == 1)": False,
    ".a | sort_by(.b)": True, ".a | sort_by(.b[])": False, ".a | length(.b)": False, ".a | select(not(.b) or .c > -1.5 and .d != null)": True, ".a & .b": False, ".a |": False, "": False, ".a[": False,
}


def _accepted(question: str) -> bool:
    try:
        jsonpath.parse(question)
    except jsonpath.UsageError:
        return False
    return True


@_add("json_questions", "SELECT * FROM (VALUES " + ", ".join(f"('{q}', {str(ok).lower()})" for q, ok in QUESTIONS.items()) + ") v(question, accepted)")
def json_questions(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(q, _accepted(q)) for q in QUESTIONS], "question string, accepted boolean")
