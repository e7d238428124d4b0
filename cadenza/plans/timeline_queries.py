"""Registered queries of the series, timeline and validation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import scalar
from cadenza.operators import alignment, series, timeline, validate
from cadenza.operators import intervals as iv
from cadenza.plans.tables import BUCKET_MS, EVENTS_SQL, MONTH_MS, SEGMENTS_SQL, lengths, segments, spans, table

QUERIES: dict = {}
ORACLES: dict = {}
SEG_BUCKET = 120_000


def _add(name: str, sql: str | None, *ctes: str):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return register


LEVELS = "frames AS (SELECT source_id, start_ms / 1000.0 AS t_s, CASE WHEN pos % 50 = 0 THEN NULL ELSE -value / 8 END AS rms_db FROM ev), buckets AS (SELECT source_id, floor(t_s / 86400) AS bucket, greatest(-90, CASE WHEN avg(CASE WHEN rms_db IS NULL THEN 0 ELSE pow(10, rms_db / 20) END) > 0 THEN 20 * log10(avg(CASE WHEN rms_db IS NULL THEN 0 ELSE pow(10, rms_db / 20) END)) ELSE -90 END) AS level_db FROM frames GROUP BY 1, 2)"
PLACES = "places AS (SELECT *, coalesce(CAST(sum(out_ms - in_ms) OVER (PARTITION BY edl_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS master_in_ms, CAST(sum(out_ms - in_ms) OVER (PARTITION BY edl_id ORDER BY pos) AS BIGINT) AS master_out_ms FROM seg)"
POINTS = "points AS (SELECT o_orderkey AS edl_id, k AS q, k * 23500 AS at_ms FROM orders, (SELECT unnest([CAST(0 AS BIGINT), 1, 2, 3, 4]) AS k) WHERE o_orderkey IN (SELECT edl_id FROM seg))"
# An earlier and a later version of each edit: lines come and go, and some are trimmed.
BEFORE = "before AS (SELECT edl_id, CAST(row_number() OVER (PARTITION BY edl_id ORDER BY pos) AS BIGINT) AS pos, source_id, in_ms, out_ms FROM seg WHERE (edl_id + pos) % 5 <> 0)"
AFTER = "after AS (SELECT edl_id, CAST(row_number() OVER (PARTITION BY edl_id ORDER BY pos) AS BIGINT) AS pos, source_id, in_ms, CASE WHEN (edl_id + pos) % 7 = 0 THEN out_ms - 500 ELSE out_ms END AS out_ms FROM seg WHERE (edl_id + pos) % 4 <> 0)"


def _frames(s: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("pos") % 50 == 0, F.lit(float("-inf"))).otherwise(-F.col("value") / 8)
    return spans(s, d).select("source_id", (F.col("start_ms") / 1000.0).alias("t_s"), level.alias("rms_db"))


def _points(s: SparkSession, d: str) -> DataFrame:
    rows = segments(s, d).select("edl_id").distinct().select("edl_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("q"))
    return rows.withColumn("at_ms", F.col("q") * 23_500)


def _version(s: SparkSession, d: str, later: bool) -> DataFrame:
    rows = segments(s, d).where((F.col("edl_id") + F.col("pos")) % (4 if later else 5) != 0)
    if later:
        rows = rows.withColumn("out_ms", F.when((F.col("edl_id") + F.col("pos")) % 7 == 0, F.col("out_ms") - 500).otherwise(F.col("out_ms")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("edl_id").orderBy("pos")).cast("long")).select("edl_id", "pos", "source_id", "in_ms", "out_ms")


@_add("pause_clusters", """SELECT source_id, start_ms AS at_ms, nxt AS next_ms, gap AS gap_ms, med AS median_ms, round(gap / med, 3) AS ratio FROM (SELECT *, median(gap) OVER (PARTITION BY source_id) AS med FROM (
SELECT source_id, start_ms, lead(start_ms) OVER w AS nxt, lead(start_ms) OVER w - start_ms AS gap, count(*) OVER (PARTITION BY source_id) AS n FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY start_ms)) WHERE n >= 3 AND gap IS NOT NULL) WHERE med > 0 AND gap < med * 0.4""", EVENTS_SQL)
def pause_clusters(s: SparkSession, d: str) -> DataFrame:
    return series.pause_clusters(spans(s, d).withColumn("end_ms", F.col("start_ms")), ratio=0.4)


@_add("top_clusters", "SELECT source_id, at_ms, ratio FROM (SELECT source_id, start_ms AS at_ms, round(gap / med, 3) AS ratio, row_number() OVER (PARTITION BY source_id ORDER BY gap, start_ms) AS n FROM (SELECT *, median(gap) OVER (PARTITION BY source_id) AS med FROM (SELECT source_id, start_ms, lead(start_ms) OVER w - start_ms AS gap, count(*) OVER (PARTITION BY source_id) AS c FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY start_ms)) WHERE c >= 3 AND gap IS NOT NULL) WHERE med > 0 AND gap < med * 0.4) WHERE n <= 3", EVENTS_SQL)
def top_clusters(s: SparkSession, d: str) -> DataFrame:
    """The three tightest clusters of each source; the limit is the feature."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("gap_ms", "at_ms"))
    return pause_clusters(s, d).withColumn("n", n).where("n <= 3").select("source_id", "at_ms", "ratio")


@_add("noise_floor", "SELECT source_id, CASE WHEN count(*) >= 3 THEN round(min(level_db), 6) END AS floor_db, count(*) AS windows FROM buckets GROUP BY source_id", EVENTS_SQL, LEVELS)
def noise_floor(s: SparkSession, d: str) -> DataFrame:
    return series.noise_floor(_frames(s, d), width_s=86400.0).withColumn("floor_db", F.round("floor_db", 6))


@_add("median_level", "SELECT source_id, round(list_sort(list(level_db))[CAST(count(*) // 2 AS INTEGER) + 1], 6) AS median_db FROM buckets GROUP BY source_id", EVENTS_SQL, LEVELS)
def median_level(s: SparkSession, d: str) -> DataFrame:
    return series.median_level(_frames(s, d), width_s=86400.0).withColumn("median_db", F.round("median_db", 6))


@_add("threshold", "SELECT source_id, round(greatest(CASE WHEN med IS NULL OR flo <= med - 20 THEN flo + 10 END, med - 20), 6) AS threshold_db FROM (SELECT source_id, CASE WHEN count(*) >= 3 THEN min(level_db) END AS flo, list_sort(list(level_db))[CAST(count(*) // 2 AS INTEGER) + 1] AS med FROM buckets GROUP BY source_id)", EVENTS_SQL, LEVELS)
def threshold(s: SparkSession, d: str) -> DataFrame:
    frames = _frames(s, d)
    rows = series.noise_floor(frames, width_s=86400.0).join(series.median_level(frames, width_s=86400.0), "source_id")
    return rows.select("source_id", F.round(series.threshold(F.col("floor_db"), F.col("median_db")), 6).alias("threshold_db"))


@_add("quiet_segments", "SELECT source_id, pos, round(mean_db, 6) AS mean_db, round(med, 6) AS median_db FROM (SELECT source_id, pos, -value / 8 AS mean_db FROM ev WHERE pos % 50 <> 0) JOIN (SELECT source_id, list_sort(list(-value / 8))[CAST(count(*) // 2 AS INTEGER) + 1] AS med FROM ev WHERE pos % 50 <> 0 GROUP BY source_id HAVING count(*) >= 3) USING (source_id) WHERE med - mean_db >= 12", EVENTS_SQL)
def quiet_segments(s: SparkSession, d: str) -> DataFrame:
    levels = spans(s, d).select("source_id", "pos", F.when(F.col("pos") % 50 == 0, F.lit(float("nan"))).otherwise(-F.col("value") / 8).alias("mean_db"))
    return series.quiet_segments(levels).select("source_id", "pos", F.round("mean_db", 6).alias("mean_db"), F.round("median_db", 6).alias("median_db"))


@_add("envelope", "SELECT label AS source_id, i // 16 AS block, round(sqrt(avg(x * x)), 6) AS rms FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, row_number() OVER () AS r, vec_id, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE vec_id IS NOT NULL) GROUP BY label, vec_id, i // 16 HAVING count(*) = 16")
def envelope(s: SparkSession, d: str) -> DataFrame:
    samples = table(s, d, "embeddings").select(F.col("label").alias("source_id"), "vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return series.envelope(samples, ("source_id", "vec_id"), 16).select("source_id", "block", F.round("rms", 6).alias("rms"))


@_add("pearson", """SELECT vec_id, round(coalesce(CASE WHEN spread > 1e-12 THEN (n * xy - sx * sy) / sqrt(spread) END, 0), 5) AS correlation FROM (SELECT *, (n * xx - sx * sx) * (n * yy - sy * sy) AS spread FROM (
SELECT a.vec_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) a
JOIN (SELECT vec_id - 1 AS vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS i FROM embeddings) b USING (vec_id, i) GROUP BY a.vec_id))""")
def pearson(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select("vec_id", "embedding")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(series.pearson(F.col("embedding"), F.col("other")), 5).alias("correlation"))


@_add("pearson_rows", "SELECT label, count(*) AS n, round(coalesce(corr(x, y), 0), 5) AS correlation FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label")
def pearson_rows(s: SparkSession, d: str) -> DataFrame:
    pairs = table(s, d, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return series.pearson_rows(pairs, ["label"]).withColumn("correlation", F.round("correlation", 5))


@_add("audit_plan", "SELECT edl_id, pos, CAST(least(1500, floor((out_ms - in_ms) * 0.8)) AS BIGINT) AS window_ms, in_ms + 100 AS source_at_ms, master_in_ms + 100 AS master_at_ms FROM places WHERE least(1500, floor((out_ms - in_ms) * 0.8)) >= 400", SEGMENTS_SQL, PLACES)
def audit_plan(s: SparkSession, d: str) -> DataFrame:
    return series.audit_plan(timeline.placements(segments(s, d))).select("edl_id", "pos", "window_ms", "source_at_ms", "master_at_ms")


@_add("audit_report", "SELECT vec_id, correlation, correlation < 0.8 AS suspect FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS correlation FROM embeddings)")
def audit_report(s: SparkSession, d: str) -> DataFrame:
    return series.audit_report(table(s, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("correlation")))


@_add("pause_total", "SELECT source_id, CAST(sum(CASE WHEN reach > 0 THEN greatest(0, start_ms - reach) ELSE 0 END) AS BIGINT) AS pause_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words) GROUP BY source_id", EVENTS_SQL)
def pause_total(s: SparkSession, d: str) -> DataFrame:
    return series.pause_total(spans(s, d, "words"))


@_add("summary", "SELECT edl_id, CAST(max(out_ms) + 5000 AS BIGINT) AS duration_ms, CAST(sum(out_ms - in_ms) AS BIGINT) AS kept_ms, count(*) AS segments, round((max(out_ms) + 5000 - sum(out_ms - in_ms)) * 100.0 / (max(out_ms) + 5000), 2) AS removal_percent FROM seg GROUP BY edl_id", SEGMENTS_SQL)
def summary(s: SparkSession, d: str) -> DataFrame:
    rows = segments(s, d)
    ends = rows.groupBy("edl_id").agg((F.max("out_ms") + 5000).alias("duration_ms"))
    return series.summary(rows, ends, ("edl_id",))


@_add("silence_summary", "SELECT source_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS removable_ms, count(*) AS silences, max(end_ms - start_ms) AS longest_ms, CAST(greatest(0, sum(end_ms - start_ms) - count(*) * 200) AS BIGINT) AS net_ms FROM silences GROUP BY source_id", EVENTS_SQL)
def silence_summary(s: SparkSession, d: str) -> DataFrame:
    return series.silence_summary(spans(s, d, "silences"))


@_add("standdown", f"SELECT l.source_id, duration_ms, coalesce(o, 0) AS offered_ms, coalesce(o, 0) > duration_ms * 0.1 AS stood_down, CASE WHEN coalesce(o, 0) > duration_ms * 0.1 THEN 0 ELSE coalesce(n, 0) END AS n_cut FROM lengths l LEFT JOIN (SELECT source_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS o, count(*) AS n FROM cuts GROUP BY 1) USING (source_id)", EVENTS_SQL)
def standdown(s: SparkSession, d: str) -> DataFrame:
    return series.stand_down(spans(s, d, "cuts"), lengths(s, d), budget=0.1)


@_add("considered", "SELECT source_id, kind AS instrument, count(*) AS offered, CAST(count(*) FILTER (pos % 3 = 0) AS BIGINT) AS cut FROM ev GROUP BY ALL", EVENTS_SQL)
def considered(s: SparkSession, d: str) -> DataFrame:
    rows = spans(s, d)
    merged = rows.where("pos % 3 = 0").select("source_id", F.concat_ws(": ", "kind", F.lit("measured")).alias("reason"))
    return series.considered(rows.withColumn("instrument", F.col("kind")), merged, ["view", "click", "purchase", "signup", "error"])


@_add("caption_qa", "SELECT conv_id AS source_id, count(*) AS cues, round(max(length(replace(text, chr(10), '')) * 1000.0 / 9000), 3) AS max_cps, CAST(max(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))) AS INTEGER) AS max_chars, CAST(max(len(string_split(text, chr(10)))) AS INTEGER) AS max_lines, count(*) FILTER (length(replace(text, chr(10), '')) * 1000.0 / 9000 > 20) AS too_fast, count(*) FILTER (list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 42) AS too_long, count(*) FILTER (len(string_split(text, chr(10))) > 2) AS too_tall, CAST(0 AS BIGINT) AS overlaps FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, role, text) GROUP BY conv_id")
def caption_qa(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversations").groupBy(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos")).agg(F.min_by("text", F.struct("role", "text")).alias("text"))
    return series.caption_quality(rows.withColumn("start_ms", F.col("pos") * 10000).withColumn("end_ms", F.col("start_ms") + 9000))


@_add("slow_words", "SELECT source_id, pos, round(pace, 6) AS ms_per_char FROM (SELECT *, (end_ms - start_ms) / length(text) AS pace, median((end_ms - start_ms) / length(text)) OVER (PARTITION BY source_id) AS med FROM words) WHERE pace > med * 1.5", EVENTS_SQL)
def slow_words(s: SparkSession, d: str) -> DataFrame:
    return series.slow_words(spans(s, d, "words"), factor=1.5).select("source_id", "pos", F.round("ms_per_char", 6).alias("ms_per_char"))


@_add("placements", "SELECT edl_id, pos, source_id, in_ms, out_ms, master_in_ms, master_out_ms FROM places", SEGMENTS_SQL, PLACES)
def placements(s: SparkSession, d: str) -> DataFrame:
    return timeline.placements(segments(s, d)).select("edl_id", "pos", "source_id", "in_ms", "out_ms", "master_in_ms", "master_out_ms")


@_add("locate_master", "SELECT q.edl_id, q.q, q.at_ms, p.pos, q.at_ms - p.master_in_ms + p.in_ms AS source_ms FROM points q LEFT JOIN places p ON p.edl_id = q.edl_id AND p.master_in_ms <= q.at_ms AND q.at_ms < p.master_out_ms", SEGMENTS_SQL, PLACES, POINTS)
def locate_master(s: SparkSession, d: str) -> DataFrame:
    return timeline.master_to_source(_points(s, d), timeline.placements(segments(s, d)), bucket_ms=SEG_BUCKET)


@_add("locate_source", "SELECT q.edl_id, q.q, q.at_ms, p.pos, q.at_ms - p.in_ms + p.master_in_ms AS master_ms FROM points q LEFT JOIN places p ON p.edl_id = q.edl_id AND p.in_ms <= q.at_ms AND q.at_ms < p.out_ms", SEGMENTS_SQL, PLACES, POINTS)
def locate_source(s: SparkSession, d: str) -> DataFrame:
    return timeline.source_to_master(_points(s, d), timeline.placements(segments(s, d)), bucket_ms=SEG_BUCKET)


@_add("neighbours", "SELECT edl_id, pos, lag(pos) OVER w AS prev_pos, lead(pos) OVER w AS next_pos, CASE WHEN lag(source_id) OVER w = source_id THEN in_ms - lag(out_ms) OVER w END AS cut_before_ms FROM seg WINDOW w AS (PARTITION BY edl_id ORDER BY pos)", SEGMENTS_SQL)
def neighbours(s: SparkSession, d: str) -> DataFrame:
    return timeline.neighbours(segments(s, d)).select("edl_id", "pos", "prev_pos", "next_pos", "cut_before_ms")


@_add("next_surviving", """SELECT q.edl_id, q.q, q.at_ms, CASE WHEN q.at_ms >= e.duration_ms THEN 'past-end' WHEN p.pos IS NULL THEN 'removed' ELSE 'kept' END AS status, q.at_ms - p.in_ms + p.master_in_ms AS master_ms,
CASE WHEN q.at_ms < e.duration_ms AND p.pos IS NULL THEN (SELECT min(n.pos) FROM places n WHERE n.edl_id = q.edl_id AND n.in_ms >= q.at_ms) END AS next_pos
FROM points q LEFT JOIN places p ON p.edl_id = q.edl_id AND p.in_ms <= q.at_ms AND q.at_ms < p.out_ms JOIN (SELECT edl_id, max(out_ms) AS duration_ms FROM seg GROUP BY 1) e ON e.edl_id = q.edl_id""", SEGMENTS_SQL, PLACES, POINTS)
def next_surviving(s: SparkSession, d: str) -> DataFrame:
    rows = segments(s, d)
    ends = rows.groupBy("edl_id").agg(F.max("out_ms").alias("duration_ms"))
    return timeline.locate(_points(s, d), timeline.placements(rows), ends, bucket_ms=SEG_BUCKET).select("edl_id", "q", "at_ms", "status", "master_ms", "next_pos")


VERSIONS = (SEGMENTS_SQL, BEFORE, AFTER, PLACES.replace("places AS", "pb AS").replace("FROM seg", "FROM before"), PLACES.replace("places AS", "pa AS").replace("FROM seg", "FROM after"), POINTS)


@_add("relocate", "SELECT q.edl_id, q.q, q.at_ms AS old_ms, q.at_ms - b.master_in_ms + b.in_ms - a.in_ms + a.master_in_ms AS new_ms FROM points q LEFT JOIN pb b ON b.edl_id = q.edl_id AND b.master_in_ms <= q.at_ms AND q.at_ms < b.master_out_ms LEFT JOIN pa a ON a.edl_id = q.edl_id AND a.in_ms <= q.at_ms - b.master_in_ms + b.in_ms AND q.at_ms - b.master_in_ms + b.in_ms < a.out_ms", *VERSIONS)
def relocate(s: SparkSession, d: str) -> DataFrame:
    return timeline.relocate(_points(s, d), timeline.placements(_version(s, d, False)), timeline.placements(_version(s, d, True)), bucket_ms=SEG_BUCKET)


@_add("cut_projection", "SELECT q.edl_id, q.q AS pos, p.pos AS seg_pos, greatest(q.at_ms, p.master_in_ms) + p.in_ms - p.master_in_ms AS start_ms, least(q.at_ms + 15000, p.master_out_ms) + p.in_ms - p.master_in_ms AS end_ms FROM points q JOIN places p ON p.edl_id = q.edl_id AND p.master_out_ms > q.at_ms AND p.master_in_ms < q.at_ms + 15000", SEGMENTS_SQL, PLACES, POINTS)
def cut_projection(s: SparkSession, d: str) -> DataFrame:
    cuts = _points(s, d).select("edl_id", F.col("q").alias("pos"), F.col("at_ms").alias("start_ms"), (F.col("at_ms") + 15_000).alias("end_ms"))
    return timeline.project_cuts(cuts, timeline.placements(segments(s, d)), bucket_ms=SEG_BUCKET)


AT_SPEECH = """spot AS (SELECT g.source_id, g.pos, g.start_ms AS in_ms, g.start_ms - g.prev AS cut_ms, (SELECT count(*) FROM words w WHERE w.source_id = g.source_id AND w.end_ms > g.prev AND w.start_ms < g.start_ms) AS words_removed
FROM (SELECT *, lag(end_ms) OVER (PARTITION BY source_id ORDER BY pos) AS prev FROM proposals) g WHERE g.start_ms > g.prev AND EXISTS (SELECT 1 FROM cuts c WHERE c.source_id = g.source_id AND c.end_ms > g.prev AND c.start_ms < g.start_ms))"""


def _kept(s: SparkSession, d: str) -> DataFrame:
    return spans(s, d, "proposals").select("source_id", "pos", F.col("start_ms").alias("in_ms"), F.col("end_ms").alias("out_ms"))


@_add("boundaries_after", "SELECT * FROM spot", EVENTS_SQL, AT_SPEECH)
def boundaries_after(s: SparkSession, d: str) -> DataFrame:
    return timeline.boundaries_after_speech(_kept(s, d), spans(s, d, "cuts"), spans(s, d, "words"), ("source_id",), BUCKET_MS)


@_add("joins", "SELECT a.*, p.master_in_ms, (SELECT min(c.pos) FROM cuts c WHERE c.source_id = a.source_id AND c.end_ms > a.in_ms - a.cut_ms AND c.start_ms < a.in_ms) AS cut_pos FROM spot a JOIN (SELECT source_id, pos, coalesce(CAST(sum(end_ms - start_ms) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS master_in_ms FROM proposals) p USING (source_id, pos)", EVENTS_SQL, AT_SPEECH)
def joins(s: SparkSession, d: str) -> DataFrame:
    return timeline.joins(_kept(s, d), spans(s, d, "cuts"), spans(s, d, "words"), ("source_id",), BUCKET_MS)


@_add("report_match", "SELECT c.source_id, c.pos, c.start_ms, c.end_ms, r.pos AS report_pos, r.start_ms = c.start_ms AND r.end_ms = c.end_ms AS exact FROM cuts c LEFT JOIN (SELECT source_id, pos, start_ms + pos % 60 AS start_ms, end_ms FROM cuts) r ON r.source_id = c.source_id AND abs(r.start_ms - c.start_ms) < 50 AND abs(r.end_ms - c.end_ms) < 50", EVENTS_SQL)
def report_match(s: SparkSession, d: str) -> DataFrame:
    cuts = spans(s, d, "cuts").select("source_id", "pos", "start_ms", "end_ms")
    return timeline.match_reports(cuts, cuts.withColumn("start_ms", F.col("start_ms") + F.col("pos") % 60), 50, ("source_id",))


@_add("semantic_risk", "SELECT source_id, pos, in_ms, out_ms, CASE WHEN EXISTS (SELECT 1 FROM cuts p WHERE p.source_id = s.source_id AND (abs(p.start_ms - in_ms) <= 3600000 OR abs(p.end_ms - in_ms) <= 3600000 OR abs(p.start_ms - out_ms) <= 3600000 OR abs(p.end_ms - out_ms) <= 3600000)) THEN 'material' ELSE 'low' END AS semantic_risk FROM (SELECT source_id, pos, start_ms AS in_ms, end_ms AS out_ms FROM proposals) s", EVENTS_SQL)
def semantic_risk(s: SparkSession, d: str) -> DataFrame:
    return timeline.semantic_risk(_kept(s, d), spans(s, d, "cuts"), 3_600_000, ("source_id",))


@_add("edl_cuts", "SELECT edl_id, prev AS start_ms, in_ms AS end_ms FROM (SELECT *, coalesce(lag(out_ms) OVER (PARTITION BY edl_id ORDER BY in_ms, pos), 0) AS prev FROM seg) WHERE in_ms > prev UNION ALL SELECT edl_id, max(out_ms), max(out_ms) + 5000 FROM seg GROUP BY edl_id", SEGMENTS_SQL)
def edl_cuts(s: SparkSession, d: str) -> DataFrame:
    rows = segments(s, d)
    return iv.edl_cuts(rows, rows.groupBy("edl_id").agg((F.max("out_ms") + 5000).alias("duration_ms")), ("edl_id",))


@_add("content_changed", "SELECT * FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.edl_id = a.edl_id AND b.source_id = a.source_id AND b.in_ms = a.in_ms AND b.out_ms = a.out_ms)", SEGMENTS_SQL, BEFORE, AFTER)
def content_changed(s: SparkSession, d: str) -> DataFrame:
    return timeline.content_changed(_version(s, d, False), _version(s, d, True))


CLOSED = "closed AS (SELECT edl_id, pt AS left_pos, to_pos AS right_pos FROM (SELECT b.edl_id, b.pos, a.pos AS to_pos, lag(b.pos) OVER w AS pf, lag(a.pos) OVER w AS pt FROM before b JOIN after a USING (edl_id, source_id, in_ms, out_ms) WINDOW w AS (PARTITION BY b.edl_id ORDER BY b.pos)) WHERE pos - pf > 1 AND to_pos - pt = 1)"
CHANGED = "changed AS (SELECT edl_id, pos FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.edl_id = a.edl_id AND b.source_id = a.source_id AND b.in_ms = a.in_ms AND b.out_ms = a.out_ms))"


@_add("closed_gaps", "SELECT * FROM closed", SEGMENTS_SQL, BEFORE, AFTER, CLOSED)
def closed_gaps(s: SparkSession, d: str) -> DataFrame:
    return timeline.closed_gaps(_version(s, d, False), _version(s, d, True))


@_add("delta_spans", "SELECT a.*, CASE WHEN min(r.rank) = 0 THEN 'content-changed' ELSE 'neighbour-of-new-join' END AS reason FROM after a JOIN (SELECT edl_id, pos, 0 AS rank FROM changed UNION ALL SELECT edl_id, pos - 1, 1 FROM changed UNION ALL SELECT edl_id, pos + 1, 1 FROM changed UNION ALL SELECT edl_id, left_pos, 1 FROM closed UNION ALL SELECT edl_id, right_pos, 1 FROM closed) r USING (edl_id, pos) GROUP BY ALL", SEGMENTS_SQL, BEFORE, AFTER, CLOSED, CHANGED)
def delta_spans(s: SparkSession, d: str) -> DataFrame:
    return timeline.delta(_version(s, d, False), _version(s, d, True))


@_add("delta_totals", "SELECT edl_id, count(*) AS segments, CAST(sum(out_ms - in_ms) AS BIGINT) AS total_ms FROM (SELECT DISTINCT a.* FROM after a JOIN (SELECT edl_id, pos FROM changed UNION ALL SELECT edl_id, pos - 1 FROM changed UNION ALL SELECT edl_id, pos + 1 FROM changed UNION ALL SELECT edl_id, left_pos FROM closed UNION ALL SELECT edl_id, right_pos FROM closed) r USING (edl_id, pos)) GROUP BY edl_id", SEGMENTS_SQL, BEFORE, AFTER, CLOSED, CHANGED)
def delta_totals(s: SparkSession, d: str) -> DataFrame:
    return delta_spans(s, d).groupBy("edl_id").agg(F.count("*").alias("segments"), F.sum(F.col("out_ms") - F.col("in_ms")).alias("total_ms"))


@_add("carry_forward", "SELECT q.edl_id, q.q, q.old_ms, q.new_ms AS start_ms, q.new_ms + 1000 AS end_ms FROM (SELECT q.edl_id, q.q, q.at_ms AS old_ms, q.at_ms - b.master_in_ms + b.in_ms - a.in_ms + a.master_in_ms AS new_ms FROM points q JOIN pb b ON b.edl_id = q.edl_id AND b.master_in_ms <= q.at_ms AND q.at_ms < b.master_out_ms JOIN pa a ON a.edl_id = q.edl_id AND a.in_ms <= q.at_ms - b.master_in_ms + b.in_ms AND q.at_ms - b.master_in_ms + b.in_ms < a.out_ms) q WHERE NOT EXISTS (SELECT 1 FROM pa a JOIN changed c USING (edl_id, pos) WHERE a.edl_id = q.edl_id AND a.master_in_ms - 16000 <= q.new_ms AND q.new_ms < a.master_out_ms + 16000)", *VERSIONS, CHANGED)
def carry_forward(s: SparkSession, d: str) -> DataFrame:
    before, after = _version(s, d, False), _version(s, d, True)
    places = timeline.placements(after)
    changed = timeline.content_changed(before, after).select("edl_id", "pos")
    swept = places.join(changed, ["edl_id", "pos"]).select("edl_id", F.col("master_in_ms").alias("start_ms"), F.col("master_out_ms").alias("end_ms"))
    return timeline.carry_forward(_points(s, d).withColumn("width_ms", F.lit(1000)), timeline.placements(before), places, swept, bucket_ms=SEG_BUCKET)


@_add("finding_diff", "SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.start_ms, b.start_ms) AS start_ms, coalesce(a.end_ms, b.end_ms) AS end_ms, coalesce(a.text, b.text) AS text, CASE WHEN a.source_id IS NOT NULL AND b.source_id IS NOT NULL THEN 'standing' WHEN a.source_id IS NOT NULL THEN 'addressed' ELSE 'new' END AS status FROM words a FULL JOIN (SELECT * REPLACE (CASE WHEN pos % 4 = 0 THEN text || ' x' ELSE text END AS text) FROM words) b ON a.source_id = b.source_id AND a.start_ms = b.start_ms AND a.end_ms = b.end_ms AND a.text = b.text", EVENTS_SQL)
def finding_diff(s: SparkSession, d: str) -> DataFrame:
    rows = spans(s, d, "words")
    return timeline.finding_diff(rows, rows.withColumn("text", F.when(F.col("pos") % 4 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))), ("source_id",))


@_add("round_deltas", "SELECT source_id, round, removal_percent, segments, round(removal_percent - lag(removal_percent) OVER w, 2) AS removal_delta, segments - lag(segments) OVER w AS segments_delta FROM (SELECT source_id, start_ms // 604800000 AS round, round(sum(end_ms - start_ms) / 6048000.0, 2) AS removal_percent, count(*) AS segments FROM cuts GROUP BY ALL) WINDOW w AS (PARTITION BY source_id ORDER BY round)", EVENTS_SQL)
def round_deltas(s: SparkSession, d: str) -> DataFrame:
    rows = spans(s, d, "cuts").groupBy("source_id", F.floor(F.col("start_ms") / 604_800_000).alias("round"))
    return timeline.round_deltas(rows.agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 6_048_000.0, 2).alias("removal_percent"), F.count("*").alias("segments")), ("source_id",))


@_add("sliding_tiles", "SELECT edl_id, s AS start_ms, least(s + 16000, dur) AS end_ms FROM (SELECT edl_id, max(out_ms) AS dur FROM seg GROUP BY 1), LATERAL (SELECT unnest(range(0, dur, 8000)) AS s) WHERE s = 0 OR s - 8000 + 16000 < dur", SEGMENTS_SQL)
def sliding_tiles(s: SparkSession, d: str) -> DataFrame:
    ends = segments(s, d).groupBy("edl_id").agg(F.max("out_ms").alias("duration_ms"))
    return timeline.tiles(ends, 16_000, 8_000).select("edl_id", "start_ms", "end_ms")


@_add("span_tiles", "SELECT DISTINCT edl_id, a + s AS start_ms, a + least(s + 16000, b - a) AS end_ms FROM (SELECT edl_id, greatest(0, in_ms - 16000) AS a, least(out_ms + 16000, max(out_ms) OVER (PARTITION BY edl_id)) AS b, flag FROM seg) t, LATERAL (SELECT unnest(range(0, b - a, 8000)) AS s) WHERE flag = 'R' AND (s = 0 OR s - 8000 + 16000 < b - a)", SEGMENTS_SQL)
def span_tiles(s: SparkSession, d: str) -> DataFrame:
    rows = segments(s, d)
    ends = rows.groupBy("edl_id").agg(F.max("out_ms").alias("duration_ms"))
    picked = rows.where("flag = 'R'").select("edl_id", F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"))
    return timeline.span_tiles(picked, ends, 16_000, 8_000)


@_add("chunk_count", "SELECT edl_id, CAST(greatest(1, ceil(max(out_ms) / 30000.0)) AS BIGINT) AS chunks FROM seg GROUP BY edl_id", SEGMENTS_SQL)
def chunk_count(s: SparkSession, d: str) -> DataFrame:
    return segments(s, d).groupBy("edl_id").agg(F.max("out_ms").alias("x")).select("edl_id", timeline.chunks(F.col("x"), 30_000).alias("chunks"))


@_add("expected_frames", "SELECT edl_id, CAST(sum(ceil(out_ms / 1000.0 * 29.97 - 1e-6) - ceil(in_ms / 1000.0 * 29.97 - 1e-6)) AS BIGINT) AS frames FROM seg GROUP BY edl_id", SEGMENTS_SQL)
def expected_frames(s: SparkSession, d: str) -> DataFrame:
    return segments(s, d).groupBy("edl_id").agg(F.sum(scalar.expected_frames(F.col("in_ms"), F.col("out_ms"), F.lit(29.97))).alias("frames"))


PROPOSALS = "rows AS (SELECT source_id, start_ms - 500 AS start_ms, CASE WHEN pos % 11 = 0 THEN start_ms - 600 ELSE end_ms END AS end_ms, CASE pos % 4 WHEN 0 THEN 'filler' WHEN 1 THEN 'repetition' WHEN 2 THEN 'non-speech' ELSE 'unheard-of' END AS kind, CASE WHEN pos % 7 = 0 THEN ' ' ELSE 'because' END AS reason, pos FROM ev)"


def _proposals(s: SparkSession, d: str) -> DataFrame:
    pos = F.col("pos")
    kind = F.when(pos % 4 == 0, "filler").when(pos % 4 == 1, "repetition").when(pos % 4 == 2, "non-speech").otherwise("unheard-of")
    end = F.when(pos % 11 == 0, F.col("start_ms") - 600).otherwise(F.col("end_ms"))
    return spans(s, d).select("source_id", (F.col("start_ms") - 500).alias("start_ms"), end.alias("end_ms"), kind.alias("kind"), F.when(pos % 7 == 0, " ").otherwise("because").alias("reason"), "pos")


@_add("proposal_issues", f"SELECT source_id, pos, CASE WHEN start_ms < 0 THEN 'start is before 0' WHEN end_ms <= start_ms THEN 'end must come after start' WHEN end_ms > 2500000000 THEN 'end is past the source' WHEN kind = 'unheard-of' THEN 'unknown kind' WHEN trim(reason) = '' THEN 'reason is empty' END AS problem FROM rows", EVENTS_SQL, PROPOSALS)
def proposal_issues(s: SparkSession, d: str) -> DataFrame:
    return validate.proposal_problems(_proposals(s, d).withColumn("duration_ms", F.lit(2_500_000_000).cast("long"))).select("source_id", "pos", "problem")


@_add("merge_proposals", "SELECT source_id, start_ms, end_ms, kind, reason, count(*) - 1 AS duplicates, CAST(min(f) AS INTEGER) AS first_file FROM (SELECT *, 0 AS f FROM rows UNION ALL SELECT * REPLACE (end_ms + pos % 2 AS end_ms), 1 FROM rows) GROUP BY source_id, start_ms, end_ms, kind, reason", EVENTS_SQL, PROPOSALS)
def merge_proposals(s: SparkSession, d: str) -> DataFrame:
    rows = _proposals(s, d)
    return validate.merge_proposals(rows.drop("pos"), rows.withColumn("end_ms", F.col("end_ms") + F.col("pos") % 2).drop("pos"))


@_add("segment_issues", """SELECT edl_id, pos, problem FROM (SELECT *, lag(out_ms) OVER (PARTITION BY edl_id ORDER BY pos) AS prev, count(*) OVER (PARTITION BY edl_id, id) AS n FROM (SELECT edl_id, pos, CASE WHEN pos % 5 = 0 THEN in_ms - 9000 ELSE in_ms END AS in_ms, out_ms, 'segment-' || (pos % 6) AS id, flag FROM seg)),
LATERAL (SELECT unnest([CASE WHEN in_ms < 0 THEN 'in is before 0' END, CASE WHEN out_ms <= in_ms THEN 'out must come after in' END, CASE WHEN out_ms > 100000 THEN 'out is past the source' END, CASE WHEN in_ms < coalesce(prev, 0) THEN 'segments overlap or run backwards' END, CASE WHEN n > 1 THEN 'id is used twice' END, CASE WHEN flag = 'R' THEN 'unknown approval' END]) AS problem) WHERE problem IS NOT NULL""", SEGMENTS_SQL)
def segment_issues(s: SparkSession, d: str) -> DataFrame:
    rows = segments(s, d).withColumn("in_ms", F.when(F.col("pos") % 5 == 0, F.col("in_ms") - 9000).otherwise(F.col("in_ms"))).withColumn("id", F.concat(F.lit("segment-"), (F.col("pos") % 6).cast("string")))
    rows = rows.withColumn("approval", F.when(F.col("flag") == "R", "maybe").otherwise("approved")).withColumn("semantic_risk", F.lit("low")).withColumn("crop", F.lit(None).cast("struct<x:double,y:double,width:double,height:double>"))
    return validate.segment_problems(rows, rows.select("edl_id").distinct().withColumn("duration_ms", F.lit(100_000)))


@_add("edl_issues", "SELECT o_orderkey AS edl_id, unnest(list_filter([CASE WHEN n = 0 THEN 'no segments' END, CASE WHEN n > 5 THEN 'too many segments' END, CASE WHEN o_orderstatus = 'F' AND w > 0 THEN 'approved with segments that are not' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT o_orderkey, o_orderstatus, count(edl_id) AS n, count(*) FILTER (flag = 'R') AS w FROM orders LEFT JOIN seg ON edl_id = o_orderkey GROUP BY ALL)", SEGMENTS_SQL)
def edl_issues(s: SparkSession, d: str) -> DataFrame:
    edls = table(s, d, "orders").select(F.col("o_orderkey").alias("edl_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("approval"))
    rows = segments(s, d).withColumn("approval", F.when(F.col("flag") == "R", "pending").otherwise("approved"))
    return validate.edl_problems(edls, rows, most=5)


OUTPUT = "out AS (SELECT o_orderkey AS id, o_orderkey % 1000 AS expected_frames, o_orderkey % 1000 + o_orderkey % 4 AS frames, 1000 AS expected_ms, 1000 + o_orderkey % 200 AS measured_ms, 1000 + o_orderkey % 300 AS audio_ms FROM orders)"


def _outputs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("id"), (k % 1000).alias("expected_frames"), (k % 1000 + k % 4).alias("frames"), F.lit(1000).alias("expected_ms"), (1000 + k % 200).alias("measured_ms"), (1000 + k % 300).alias("audio_ms"), F.lit(25.0).alias("fps"))


@_add("output_issues", "SELECT id, unnest(list_filter([CASE WHEN abs(frames - expected_frames) > 1 THEN 'frame count differs' END, CASE WHEN abs(measured_ms - expected_ms) > 100 THEN 'length differs' END, CASE WHEN abs(audio_ms - measured_ms) > 100 THEN 'sound and picture differ' END], lambda x: x IS NOT NULL)) AS problem FROM out", OUTPUT)
def output_issues(s: SparkSession, d: str) -> DataFrame:
    return validate.output_problems(_outputs(s, d))


@_add("audio_issues", "SELECT id, 'length differs' AS problem FROM out WHERE abs(audio_ms - expected_ms) > 10", OUTPUT)
def audio_issues(s: SparkSession, d: str) -> DataFrame:
    return validate.audio_problems(_outputs(s, d))


@_add("render_match", "SELECT id, abs(measured_ms - audio_ms) <= 50 AS matches FROM out", OUTPUT)
def render_match(s: SparkSession, d: str) -> DataFrame:
    return _outputs(s, d).select("id", validate.matches_render(F.col("measured_ms"), F.col("audio_ms")).alias("matches"))


@_add("check_status", "SELECT id, CASE WHEN id % 7 = 0 THEN 'rejected' WHEN id % 5 = 0 THEN 'unaddressed-repeats' WHEN id % 3 = 0 THEN 'valid-with-kept-repeats' ELSE 'valid' END AS status FROM out", OUTPUT)
def check_status(s: SparkSession, d: str) -> DataFrame:
    flag = lambda n: (F.col("id") % n == 0).cast("int")
    return _outputs(s, d).select("id", validate.check_status(flag(7), flag(5), flag(3)).alias("status"))


@_add("gate_status", "SELECT c_custkey, CASE WHEN n < 2 AND NOT ack THEN 'insufficient-rounds' WHEN r > 0 THEN 'repeated-phrases-unresolved' WHEN ack THEN 'acknowledged' ELSE 'converged-pending-review' END AS status FROM (SELECT c_custkey, count(o_orderkey) % 4 AS n, count(*) FILTER (o_orderstatus = 'O') % 3 AS r, c_custkey % 5 = 0 AS ack FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def gate_status(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("r"))
    rows = table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0)
    return rows.select("c_custkey", validate.gate_status(F.col("n") % 4, F.col("r") % 3, F.col("c_custkey") % 5 == 0).alias("status"))


@_add("cache_state", "SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'match' WHEN id % 5 = 0 THEN 'rehashed-match' ELSE 'sha-changed' END AS state FROM out", OUTPUT)
def cache_state(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return _outputs(s, d).select("id", validate.cache_state(k % 2, F.lit(0), k % 3, F.lit(0), k % 5, F.lit(0)).alias("state"))


SESSIONS = "sess AS (SELECT o_orderkey AS dir, o_orderkey % 4 <> 0 AS source_exists, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) END AS committed_at, o_orderkey % 6 = 0 AS locked, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders)"


def _sessions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("dir"), (k % 4 != 0).alias("source_exists"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("committed_at"), (k % 6 == 0).alias("locked"), F.floor("o_totalprice").alias("size_bytes"))


@_add("gc_reasons", "SELECT dir, reasons, NOT locked AND reasons NOT IN ('', 'locked-protected') AS deletable FROM (SELECT *, array_to_string(list_filter([CASE WHEN NOT source_exists THEN 'orphan' END, CASE WHEN committed_at IS NOT NULL THEN 'committed' END, CASE WHEN floor((epoch(TIMESTAMP '1998-01-01 00:00:00') - epoch(created_at)) / 86400) >= 400 THEN 'older-than' END, CASE WHEN locked THEN 'locked-protected' END], lambda x: x IS NOT NULL), ',') AS reasons FROM sess)", SESSIONS)
def gc_reasons(s: SparkSession, d: str) -> DataFrame:
    now = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return validate.collect_reasons(_sessions(s, d), 400, now).select("dir", F.array_join("reasons", ",").alias("reasons"), "deletable")


@_add("sessions_health", "SELECT count(*) AS sessions, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) FILTER (NOT source_exists) AS orphans, CAST(min(epoch(created_at)) AS BIGINT) AS oldest FROM sess", SESSIONS)
def sessions_health(s: SparkSession, d: str) -> DataFrame:
    return validate.sessions_health(_sessions(s, d)).withColumn("oldest", F.unix_seconds("oldest"))


@_add("match_targets", "SELECT id, percent, coalesce(string_agg(name, ', ' ORDER BY name), '') AS targets FROM (SELECT id, id % 100 AS percent FROM out) LEFT JOIN (VALUES ('gentle', 0, 20), ('normal', 15, 40), ('tight', 40, 70)) t(name, low, high) ON percent BETWEEN low AND high GROUP BY id, percent", OUTPUT)
def match_targets(s: SparkSession, d: str) -> DataFrame:
    ranges = s.createDataFrame([("gentle", 0, 20), ("normal", 15, 40), ("tight", 40, 70)], "name string, low int, high int")
    return validate.match_targets(_outputs(s, d).select("id", (F.col("id") % 100).alias("percent")), ranges)


#: Each earlier cut in turn takes the first later one that overlaps it and that no other has taken.
TAKEN = """sides AS (SELECT source_id, list({'s': start_ms, 'e': end_ms, 't': end_ms - pos % 2, 'r': reason} ORDER BY pos) AS x FROM cuts GROUP BY source_id),
taken AS (SELECT source_id, x, 0 AS k, CAST([] AS BIGINT[]) AS used, CAST(0 AS BIGINT) AS j FROM sides UNION ALL SELECT source_id, x, k + 1, CASE WHEN j2 > 0 THEN list_append(used, j2) ELSE used END, j2 FROM (
SELECT *, coalesce(list_filter(range(1, len(x) + 1), lambda i: NOT list_contains(used, i) AND x[i].t > x[k + 1].s AND x[i].s < x[k + 1].e)[1], 0) AS j2 FROM taken WHERE k < len(x)))"""


@_add("round_cut_diff", "SELECT source_id, CASE WHEN j = 0 THEN 'removed' WHEN x[j].s = x[k].s AND x[j].t = x[k].e AND x[j].r = x[k].r THEN 'unchanged' ELSE 'changed' END AS status, CASE WHEN j = 0 THEN x[k].s ELSE x[j].s END AS start_ms, CASE WHEN j = 0 THEN x[k].e ELSE x[j].t END AS end_ms FROM taken WHERE k > 0 UNION ALL SELECT source_id, 'added', x[i].s, x[i].t FROM (SELECT source_id, x, used, unnest(range(1, len(x) + 1)) AS i FROM taken WHERE k = len(x)) WHERE NOT list_contains(used, i)", "RECURSIVE " + EVENTS_SQL.strip(), TAKEN)
def round_cut_diff(s: SparkSession, d: str) -> DataFrame:
    rows = spans(s, d, "cuts").select("source_id", "pos", "start_ms", "end_ms", "reason")
    return alignment.diff_cuts(rows, rows.withColumn("end_ms", F.col("end_ms") - F.col("pos") % 2))


@_add("reference_check", f"SELECT *, coalesce(relative > 0.05, true) AS withheld FROM (SELECT source_id, kept_ms, measured_ms, CASE WHEN measured_ms > 0 THEN round(abs(kept_ms - measured_ms) / measured_ms, 4) END AS relative FROM (SELECT source_id, {MONTH_MS} - CAST(sum(end_ms - start_ms) AS BIGINT) AS kept_ms, CASE WHEN source_id % 9 = 0 THEN 0 ELSE {MONTH_MS} - 100000000 END AS measured_ms FROM cuts GROUP BY source_id))", EVENTS_SQL)
def reference_check(s: SparkSession, d: str) -> DataFrame:
    rows = spans(s, d, "cuts").groupBy("source_id").agg((F.lit(MONTH_MS) - F.sum(F.col("end_ms") - F.col("start_ms"))).alias("kept_ms"))
    return alignment.check_reference(rows.withColumn("measured_ms", F.when(F.col("source_id") % 9 == 0, 0).otherwise(MONTH_MS - 100_000_000)))


@_add("compare_cuts", """SELECT 'missed' AS verdict, source_id, pos, start_ms, end_ms, round(coverage, 6) AS coverage FROM (SELECT p.source_id, p.pos, p.start_ms, p.end_ms, coalesce(sum(CASE WHEN q.start_ms IS NOT NULL THEN least(q.end_ms, p.end_ms) - greatest(q.start_ms, p.start_ms) END), 0) / (p.end_ms - p.start_ms) AS coverage FROM silences p LEFT JOIN mc q ON q.source_id = p.source_id AND q.end_ms > p.start_ms AND q.start_ms < p.end_ms GROUP BY p.source_id, p.pos, p.start_ms, p.end_ms) WHERE coverage < 0.6
UNION ALL SELECT 'overcut', source_id, pos, start_ms, end_ms, round(coverage, 6) FROM (SELECT p.source_id, p.pos, p.start_ms, p.end_ms, coalesce(sum(CASE WHEN q.start_ms IS NOT NULL THEN least(q.end_ms, p.end_ms) - greatest(q.start_ms, p.start_ms) END), 0) / (p.end_ms - p.start_ms) AS coverage FROM cuts p LEFT JOIN ms q ON q.source_id = p.source_id AND q.end_ms > p.start_ms AND q.start_ms < p.end_ms WHERE EXISTS (SELECT 1 FROM words w WHERE w.source_id = p.source_id AND w.end_ms > p.start_ms AND w.start_ms < p.end_ms) GROUP BY p.source_id, p.pos, p.start_ms, p.end_ms) WHERE coverage < 0.6""", EVENTS_SQL, *(f"{n} AS (SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, pos ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t}))) GROUP BY source_id, island)" for n, t in (("mc", "cuts"), ("ms", "silences"))))
def compare_cuts(s: SparkSession, d: str) -> DataFrame:
    columns = ["source_id", "pos", "start_ms", "end_ms"]
    rows = alignment.compare_cuts(spans(s, d, "silences").select(columns), spans(s, d, "cuts").select(columns), spans(s, d, "words"), bucket_ms=BUCKET_MS)
    return rows.withColumn("coverage", F.round("coverage", 6))
