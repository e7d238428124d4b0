"""Registered queries of the text, alignment, parser and query-language operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import jsonpath, scalar
from cadenza.functions import text as tx
from cadenza.operators import alignment, phrases, series
from cadenza.plans import build
from cadenza.plans import interval_queries as iq
from cadenza.plans.tables import BUCKET_MS, EVENTS_SQL, MONTH_MS, lengths, lines, spans, table, turn_words, turns
from cadenza.sources import documents as sd
from cadenza.sources import logs

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, sql: str | None, *ctes: str):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return register


def n1(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def n2(x: str) -> str:
    return n1(f"strip_accents({x})")


def words_of(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda w: w <> '')"


def carry(x: str) -> str:
    return f"list_distinct(list_filter({words_of(n1(x))}, lambda w: length(w) >= 4))"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


LINES = "lines AS (SELECT doc_id AS source_id, lang, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents)"
RUNS = f"""lw AS (SELECT *, {words_of(n1('text'))} AS w FROM lines),
runs AS (SELECT source_id, lang, idx, w, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS phrase FROM lw WHERE len(w) >= 3),
counted AS (SELECT source_id, lang, phrase, CAST(sum((length(array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '')) - length(replace(array_to_string(list_transform(w, lambda x: ' ' || x || ' '), ''), ' ' || replace(phrase, ' ', '  ') || ' ', ''))) // length(' ' || replace(phrase, ' ', '  ') || ' ')) AS BIGINT) AS count, count(*) AS lines FROM runs GROUP BY 1, 2, 3 HAVING count > 1),
repeated AS (SELECT *, CAST(len(list_filter(string_split(phrase, ' '), lambda x: NOT list_contains(CASE WHEN lang LIKE 'en%' THEN {_list(tx.STOPWORDS_EN)} ELSE {_list(tx.STOPWORDS_ES)} END, strip_accents(x)))) AS INTEGER) AS content_words FROM counted)"""
TURNS = "turns AS (SELECT conv_id AS source_id, turn AS pos, role, text, turn * 10000 AS start_ms, turn * 10000 + 9000 AS end_ms FROM conversations)"
PAIRED = "paired AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY source_id ORDER BY pos, role), '') AS said FROM turns)"


def _paired(s: SparkSession, d: str) -> DataFrame:
    return turns(s, d).withColumn("said", F.coalesce(F.lag("text").over(Window.partitionBy("source_id").orderBy("pos", "role")), F.lit("")))


@_add("normalisers", rf"SELECT doc_id, md5({n1('t')}) AS plain, md5({n2('t')}) AS folded, md5(regexp_replace(lower(strip_accents(t)), '[^\p{{L}}\p{{N}}]', '', 'g')) AS token, regexp_replace(regexp_replace(lower(strip_accents(t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT doc_id, text AS t FROM documents)")
def normalisers(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    digest = lambda x: F.md5(x.cast("binary"))
    return table(s, d, "documents").select("doc_id", digest(tx.normalise(t)).alias("plain"), digest(tx.normalise_folded(t)).alias("folded"), digest(tx.token(t)).alias("token"), tx.slug(t).alias("slug"))


@_add("fold_full", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def fold_full(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.md5(tx.fold_full(F.col("text")).cast("binary")).alias("folded"))


CUES = r"cues AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY turn, n) - 1 AS pos, text FROM (SELECT conv_id AS source_id, turn, generate_subscripts(regexp_split_to_array(trim(text), '\s+'), 1) AS n, unnest(regexp_split_to_array(trim(text), '\s+')) AS text FROM conversations WHERE role = 'user'))"


@_add("join_words", r"SELECT source_id, word AS pos, string_agg(text, '' ORDER BY pos) AS text, min(pos) * 500 AS start_ms, max(pos) * 500 + 400 AS end_ms FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS word FROM (SELECT *, CASE WHEN pos = 0 OR (length(text) % 3 <> 0 AND regexp_matches(text, '[\p{L}\p{N}]')) THEN 1 ELSE 0 END AS fresh FROM cues)) GROUP BY source_id, word", CUES)
def join_words(s: SparkSession, d: str) -> DataFrame:
    return phrases.join_words(turn_words(s, d, "user").withColumn("starts_word", F.length("text") % 3 != 0))


@_add("build_lines", r"SELECT source_id, idx, min(pos) * 500 AS start_ms, max(pos) * 500 + 400 AS end_ms, regexp_replace(string_agg(text, ' ' ORDER BY pos), '\s+([,.;:!?…])', '\1', 'g') AS text FROM (SELECT *, CAST(1 + coalesce(sum(brk) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS idx FROM (SELECT *, CASE WHEN regexp_matches(text, '[.!?…]$') OR (pos % 9 = 0 AND lead(pos) OVER (PARTITION BY source_id ORDER BY pos) IS NOT NULL) THEN 1 ELSE 0 END AS brk FROM cues)) GROUP BY source_id, idx", CUES)
def build_lines(s: SparkSession, d: str) -> DataFrame:
    words = turn_words(s, d, "user")
    quiet = words.where("pos % 9 = 0").select("source_id", (F.col("start_ms") + 450).alias("start_ms"), (F.col("start_ms") + 1250).alias("end_ms"))
    return phrases.build_lines(words, quiet)


@_add("transcript_stats", "SELECT source_id, count(*) AS cues, CAST(0 AS BIGINT) AS several, true AS word_level, round(count(*) FILTER (length(text) % 3 = 0) / count(*), 6) AS fragment_ratio, count(*) FILTER (length(text) % 3 = 0) AS \"inner\" FROM cues GROUP BY source_id", CUES)
def transcript_stats(s: SparkSession, d: str) -> DataFrame:
    rows = turn_words(s, d, "user").withColumn("starts_word", F.length("text") % 3 != 0)
    return series.transcript_stats(rows).join(rows.groupBy("source_id").agg(F.count_if(~F.col("starts_word")).alias("inner")), "source_id")


@_add("repeated_phrases", "SELECT *, content_words < 2 AS discounted FROM repeated", LINES, RUNS)
def repeated_phrases(s: SparkSession, d: str) -> DataFrame:
    return phrases.repeated_phrases(lines(s, d))


@_add("top_repeats", "SELECT source_id, phrase, count FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY count DESC, phrase) AS n FROM repeated WHERE content_words >= 2) WHERE n <= 5", LINES, RUNS)
def top_repeats(s: SparkSession, d: str) -> DataFrame:
    """The five most frequent repeats of each document; the limit is the feature."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("count").desc(), "phrase"))
    return repeated_phrases(s, d).where("NOT discounted").withColumn("n", n).where("n <= 5").select("source_id", "phrase", "count")


@_add("unaddressed_repeats", "SELECT r.* FROM repeated r JOIN (SELECT doc_id, lower(strip_accents(string_split(text, chr(10))[1])) AS reason FROM documents) d ON d.doc_id = r.source_id WHERE NOT contains(reason, lower(strip_accents(phrase)))", LINES, RUNS)
def unaddressed_repeats(s: SparkSession, d: str) -> DataFrame:
    reasons = lines(s, d).where("idx = 0").select("source_id", F.col("text").alias("reason"))
    return phrases.unaddressed(repeated_phrases(s, d).drop("discounted"), reasons)


@_add("surviving_repeats", None)
def surviving_repeats(s: SparkSession, d: str) -> DataFrame:
    texts = lines(s, d).select("source_id", F.col("idx").alias("pos"), "text")
    return phrases.surviving_repeats(repeated_phrases(s, d), texts)


@_add("stacked_openers", rf"""SELECT source_id, CAST(0 AS BIGINT) AS pos, CAST(n AS INTEGER) AS n, array_to_string(op, ' ') AS phrase, 2 AS count FROM (SELECT *, lag(op) OVER (PARTITION BY source_id ORDER BY n) AS before FROM (SELECT source_id, n, {words_of(n2('sentence'))}[1:2] AS op FROM (
SELECT source_id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS sentence FROM (SELECT doc_id AS source_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)))) WHERE len(op) = 2 AND op = before""")
def stacked_openers(s: SparkSession, d: str) -> DataFrame:
    return phrases.stacked_openers(table(s, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit(0).cast("long").alias("pos"), "text"))


LEXICON = rf"""lexicon AS (SELECT source_id, idx, CASE WHEN lang LIKE 'en%' THEN len(list_filter(f, lambda w: regexp_matches(w, '^(?:{"|".join(tx.SELF_EDIT_EN["stems"])})'))) > 0 OR regexp_matches(line, ' (?:{"|".join(tx.SELF_EDIT_EN["phrases"])}) ') ELSE len(list_filter(f, lambda w: regexp_matches(w, '^(?:{"|".join(tx.SELF_EDIT_ES["stems"])})'))) > 0 OR regexp_matches(line, ' (?:{"|".join(tx.SELF_EDIT_ES["phrases"])}) ') END AS names_edit
FROM (SELECT *, ' ' || array_to_string(f, ' ') || ' ' AS line FROM (SELECT source_id, lang, idx, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(lower(strip_accents(w)), '[^\p{{L}}\p{{N}}]', '', 'g')) AS f FROM lines)))"""


@_add("meta_lexicon", "SELECT * FROM lexicon", LINES, LEXICON)
def meta_lexicon(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).select("source_id", "idx", tx.names_edit(F.col("text"), F.col("lang")).alias("names_edit"))


@_add("self_edits", "SELECT source_id, lang, idx, text, idx * 5000 AS start_ms, idx * 5000 + 4000 AS end_ms FROM lexicon JOIN lines USING (source_id, idx) WHERE names_edit AND idx % 3 <> 0", LINES, LEXICON)
def self_edits(s: SparkSession, d: str) -> DataFrame:
    rows = lines(s, d)
    return phrases.self_edits(rows, rows.where("idx % 3 = 0").select("source_id", "start_ms", "end_ms"))


@_add("hesitation", r"SELECT doc_id, regexp_matches(text, '(?i)\be+h+m?\b|\bm+h?m+\b|\ba+h+\b') AS hesitates FROM documents")
def hesitation(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", tx.hesitates(F.col("text")).alias("hesitates"))


@_add("views_disagree", f"SELECT source_id, pos, role, CASE WHEN pos % 5 = 0 AND len(b) > 0 THEN 'soft-speech' WHEN oa > 0 AND ob = 0 THEN 'transcript-claims-more' WHEN ob > 0 THEN 'heard-more' ELSE 'aligned' END AS view FROM (SELECT *, len(list_filter(a, lambda w: NOT list_contains(b, w))) AS oa, len(list_filter(b, lambda w: NOT list_contains(a, w))) AS ob FROM (SELECT *, {carry('text')} AS a, {carry('said')} AS b FROM paired))", TURNS, PAIRED)
def views_disagree(s: SparkSession, d: str) -> DataFrame:
    return _paired(s, d).select("source_id", "pos", "role", tx.views_disagree(F.col("text"), F.col("said"), F.col("pos") % 5 == 0).alias("view"))


HAS = f"has AS (SELECT *, CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda w: list_contains(heard, w))) / len(wanted) >= 0.6 ELSE false END AS found FROM (SELECT *, {words_of(n1('text'))} AS heard, CASE WHEN len(list_filter(every, lambda w: length(w) >= 4)) > 0 THEN list_filter(every, lambda w: length(w) >= 4) ELSE every END AS wanted FROM (SELECT *, {words_of(n1('said'))} AS every FROM paired)))"


@_add("contains_phrase", "SELECT source_id, pos, role, found FROM has", TURNS, PAIRED, HAS)
def contains_phrase(s: SparkSession, d: str) -> DataFrame:
    return _paired(s, d).select("source_id", "pos", "role", tx.contains_phrase(F.col("text"), F.col("said")).alias("found"))


@_add("converge", "SELECT source_id, min(start_ms) FILTER (NOT found) AS first_clear_ms, max(start_ms) FILTER (found) AS last_with_ms FROM has GROUP BY source_id", TURNS, PAIRED, HAS)
def converge(s: SparkSession, d: str) -> DataFrame:
    return phrases.first_clear(_paired(s, d).withColumn("at_ms", F.col("start_ms")), F.col("said"))


@_add("leak_reading", f"SELECT source_id, pos, role, CASE WHEN len(a) = 0 THEN 'check-by-ear' WHEN len(list_filter(a, lambda w: list_contains(b, w))) / len(a) >= 0.5 THEN 'removed-text-leaked' ELSE 'lands' END AS reading FROM (SELECT *, {carry('text')} AS a, {carry('said')} AS b FROM paired)", TURNS, PAIRED)
def leak_reading(s: SparkSession, d: str) -> DataFrame:
    return _paired(s, d).select("source_id", "pos", "role", tx.leak_reading(F.col("text"), F.col("said")).alias("reading"))


@_add("reason_mismatch", f"SELECT source_id, pos, role, len(a) >= 4 AND len(list_filter(a, lambda w: list_contains(b, w))) / greatest(1, len(a)) < 0.5 AS mismatch FROM (SELECT *, {carry('strip_accents(text)')} AS a, {words_of(n1('strip_accents(said)'))} AS b FROM paired)", TURNS, PAIRED)
def reason_mismatch(s: SparkSession, d: str) -> DataFrame:
    return _paired(s, d).select("source_id", "pos", "role", tx.reason_mismatch(F.col("text"), F.col("said")).alias("mismatch"))


@_add("nonspeech_reading", rf"SELECT source_id, pos, role, CASE WHEN regexp_matches(text, '(?i)\be+h+m?\b|\bm+h?m+\b|\ba+h+\b') THEN 'hesitation' WHEN len({words_of(n1('text'))}) > 0 THEN 'speech' WHEN pos > 3 THEN 'noise' ELSE 'silence' END AS reading FROM turns", TURNS)
def nonspeech_reading(s: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("pos") > 3, -30.0).otherwise(-60.0)
    return turns(s, d).select("source_id", "pos", "role", tx.reading_of_nonspeech(F.col("text"), level).alias("reading"))


@_add("truncated_edges", r"SELECT source_id, idx FROM lines WHERE trim(text) <> '' AND NOT regexp_matches(list_last(regexp_split_to_array(trim(text), '\s+')), '[.!?…,;:]$')", LINES)
def truncated_edges(s: SparkSession, d: str) -> DataFrame:
    return phrases.truncated_edges(lines(s, d)).select("source_id", "idx")


@_add("anomalies", f"""SELECT source_id, pos, CAST(wanted AS INTEGER) AS wanted, round(hits / wanted, 6) AS share FROM (SELECT w.source_id, w.pos, len(w.want) AS wanted, len(list_filter(w.want, lambda x: list_contains(coalesce(h.heard, []), x))) AS hits FROM (SELECT *, list_filter({words_of(n2('text'))}, lambda x: length(x) >= 4) AS want FROM turns WHERE role = 'assistant') w
LEFT JOIN (SELECT a.source_id, a.pos, list(u.w) AS heard FROM turns a JOIN (SELECT source_id, start_ms - 10000 AS s, end_ms AS e, unnest({words_of(n2('text'))}) AS w FROM turns WHERE role = 'user') u ON u.source_id = a.source_id AND u.e > a.start_ms AND u.s < a.end_ms WHERE a.role = 'assistant' GROUP BY a.source_id, a.pos) h ON h.source_id = w.source_id AND h.pos = w.pos) WHERE wanted > 0 AND hits / wanted < 0.6""", TURNS)
def anomalies(s: SparkSession, d: str) -> DataFrame:
    rows = turns(s, d)
    cached = rows.where("role = 'user'").withColumn("start_ms", F.col("start_ms") - 10000)
    out = phrases.anomalies(rows.where("role = 'assistant'"), cached)
    return out.select("source_id", "pos", "wanted", F.round("share", 6).alias("share"))


def _met(n: int) -> str:
    """Neighbouring places (a, b), from 1, of each run of n folded words of a line, with the line's words."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""fw AS MATERIALIZED (SELECT source_id, idx AS pos, lang, {words_of(n2('text'))} AS w FROM lines),
met AS (SELECT source_id, pos, lang, w, len(w) AS n, a, b FROM (SELECT * FROM (SELECT source_id, pos, i AS b, lag(i) OVER (PARTITION BY source_id, pos, run ORDER BY i) AS a FROM (SELECT source_id, pos, i, {run} AS run FROM (SELECT source_id, pos, w, unnest(range(1, len(w) - {n - 2})) AS i FROM fw))) WHERE a IS NOT NULL) JOIN fw USING (source_id, pos))"""


STOP = f"CASE WHEN lower(strip_accents(lang)) LIKE 'en%' THEN {_list(tx.STOPWORDS_EN)} ELSE {_list(tx.STOPWORDS_ES)} END"
GROWN = [
    "back AS (SELECT *, coalesce(list_filter(range(1, a), lambda k: w[a - k] <> w[b - k])[1], a) - 1 AS back FROM met)",
    "ahead AS (SELECT *, list_filter(range(3, n + 2), lambda k: a + k >= b - back OR b + k > n OR w[a + k] <> w[b + k])[1] AS size FROM back)",
    "spread AS (SELECT DISTINCT source_id, pos, lang, a - back AS s, a + size AS e FROM ahead)",
    "chained AS (SELECT source_id, pos, lang, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_id, pos ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY source_id, pos ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spread)) GROUP BY source_id, pos, lang, island)",
    "cited AS (SELECT source_id, pos, lang, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS hay, w[s:e - 1] AS p FROM chained JOIN fw USING (source_id, pos, lang))",
    f"grown AS (SELECT source_id, pos, array_to_string(p, ' ') AS phrase, CAST((length(hay) - length(replace(hay, ' ' || array_to_string(p, '  ') || ' ', ''))) // length(' ' || array_to_string(p, '  ') || ' ') AS BIGINT) AS count, CAST(len(list_filter(p, lambda x: NOT list_contains({STOP}, x))) AS INTEGER) AS content_words FROM cited)",
]


@_add("grown_repeats", f"SELECT *, content_words < {tx.CONTENT_FLOOR} AS discounted FROM grown", LINES, _met(3), *GROWN)
def grown_repeats(s: SparkSession, d: str) -> DataFrame:
    return phrases.grown_repeats(lines(s, d).withColumnRenamed("idx", "pos"))


@_add("restarts", f"SELECT DISTINCT source_id, pos, array_to_string(w[a:a + size - 1], ' ') AS phrase FROM (SELECT *, list_filter(range(2, n + 2), lambda k: a + k >= b OR b + k > n OR w[a + k] <> w[b + k])[1] AS size FROM met) WHERE a + size < b AND b + size <= n AND b - a - size < size AND len(list_filter(w[a:a + size - 1], lambda x: NOT list_contains({STOP}, x))) > 0", LINES, _met(2))
def restarts(s: SparkSession, d: str) -> DataFrame:
    return phrases.restarts(lines(s, d).withColumnRenamed("idx", "pos"))


def _line_words(text: DataFrame) -> DataFrame:
    rows = text.select("source_id", "idx", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("n", "text")).where("text != ''")
    at = F.col("idx") * 1_000_000 + F.col("n") * 500
    return rows.select("source_id", at.alias("pos"), "text", at.alias("start_ms"), (at + 400).alias("end_ms"))


@_add("repetition_cuts", None)
def repetition_cuts(s: SparkSession, d: str) -> DataFrame:
    """A line is a window of 1,998 words; those of a longer line go on into the windows of the lines after it.

    Only lines that say a run again have findings, so only these and the longer ones are taken for findings and words."""
    text = lines(s, d).withColumn("again", phrases.says_again(F.col("text")))
    found = phrases.grown_repeats(text.where("again").withColumnRenamed("idx", "pos")).where("NOT discounted").withColumn("lang", F.lit("en"))
    found = found.withColumn("start_ms", F.col("pos") * 1_000_000).withColumn("end_ms", F.col("start_ms") + 999_000)
    long = F.size(F.split(F.trim("text"), r"\s+")) > 1_998
    return phrases.repetition_cuts(found, _line_words(text.where(F.col("again") | long)), bucket_ms=1_000_000)


@_add("opcodes", None)
def opcodes(s: SparkSession, d: str) -> DataFrame:
    return alignment.opcodes(turn_words(s, d, "user"), turn_words(s, d, "assistant"))


@_add("recovered_cuts", None)
def recovered_cuts(s: SparkSession, d: str) -> DataFrame:
    words = turn_words(s, d, "user")
    quiet = words.where("pos % 20 = 0").select("source_id", (F.col("start_ms") + 400).alias("start_ms"), (F.col("start_ms") + 500).alias("end_ms"))
    return alignment.recover_cuts(words, words.where("pos % 10 < 6"), quiet)


@_add("align_tokens", r"SELECT source_id, pos, regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g') AS token FROM cues WHERE regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g') <> ''", CUES)
def align_tokens(s: SparkSession, d: str) -> DataFrame:
    return alignment.tokens(turn_words(s, d, "user")).select("source_id", "pos", "token")


# The query language, over orders with their lines as documents.


def _orders(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag")))).alias("lines")
    )
    return rows.select("id", F.to_json(F.struct(F.col("id"), "lines", F.struct(F.size("lines").alias("n")).alias("meta"))).alias("doc"))


JLINES = "jl AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), l_returnflag) - 1 AS n FROM lineitem)"


@_add("json_path", "SELECT l_orderkey AS id, CAST(count(*) AS VARCHAR) AS result FROM lineitem GROUP BY l_orderkey")
def json_path(s: SparkSession, d: str) -> DataFrame:
    return jsonpath.answer(_orders(s, d), ".meta.n")


@_add("json_iterate", "SELECT id, CASE WHEN count(*) = 1 THEN CAST(min(part) AS VARCHAR) ELSE '[' || string_agg(part, ',' ORDER BY n) || ']' END AS result FROM jl GROUP BY id", JLINES)
def json_iterate(s: SparkSession, d: str) -> DataFrame:
    return jsonpath.answer(_orders(s, d), ".lines[].part")


@_add("json_select", "SELECT id, n AS ord, part AS value FROM jl WHERE NOT (flag = 'R') AND qty > 20 OR pos = 1", JLINES)
def json_select(s: SparkSession, d: str) -> DataFrame:
    rows = jsonpath.query(_orders(s, d), '.lines[] | select(not(.flag == "R") and .qty > 20 or .pos == 1) | .part')
    return rows.select("id", F.col("ord")[0].alias("ord"), F.variant_get("value", "$", "long").alias("value"))


@_add("json_sort", "SELECT id, CASE WHEN count(*) = 1 THEN CAST(min(part) AS VARCHAR) ELSE '[' || string_agg(part, ',' ORDER BY qty, n) || ']' END AS result FROM jl GROUP BY id", JLINES)
def json_sort(s: SparkSession, d: str) -> DataFrame:
    return jsonpath.answer(_orders(s, d), ".lines | sort_by(.qty) | .[] | .part")


@_add("fields_projection", "SELECT id, string_agg(qty, ',' ORDER BY n) AS qty, CAST(count(*) AS INTEGER) AS n, 'lines.colour' AS missing FROM jl GROUP BY id", JLINES)
def fields_projection(s: SparkSession, d: str) -> DataFrame:
    docs = _orders(s, d).select(F.from_json("doc", "id long, lines array<struct<pos:int,part:long,qty:long,flag:string>>, meta struct<n:int>").alias("x")).select("x.*")
    out, missing = jsonpath.project(docs, "id,lines.qty,meta.n,lines.colour")
    return out.select("id", F.array_join(F.col("`lines.qty`").cast("array<string>"), ",").alias("qty"), F.col("`meta.n`").alias("n"), F.lit(",".join(missing)).alias("missing"))


# Parsers, over logs and captions written from the driver's tables.

LOG = """log AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, pos) AS line_no, kind, start_ms, end_ms, pos FROM ev)"""


def _log(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms", "pos"))
    sec = F.format_string("%.3f", F.col("start_ms") / 1000.0)
    end = F.format_string("%.3f", F.col("end_ms") / 1000.0)
    value = (
        F.when(F.col("kind") == "view", F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), sec))
        .when(F.col("kind") == "click", F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), sec, F.lit(" | silence_duration: 1")))
        .when(F.col("kind") == "purchase", F.concat(F.lit("lavfi.freezedetect.freeze_start: "), sec))
        .when(F.col("kind") == "signup", F.concat(F.lit("lavfi.freezedetect.freeze_end: "), sec))
        .otherwise(F.concat(F.lit("black_start:"), sec, F.lit(" black_end:"), end, F.lit(" black_duration:1")))
    )
    return spans(s, d).withColumn("line_no", n).select("source_id", "line_no", value.alias("value"))


@_add("silence_log", f"SELECT source_id, start_ms, e AS end_ms, e - start_ms AS duration_ms FROM (SELECT source_id, start_ms, CASE WHEN nk = 'click' THEN ns WHEN nk IS NULL AND {MONTH_MS} > start_ms THEN {MONTH_MS} END AS e FROM (SELECT *, lead(kind) OVER w AS nk, lead(start_ms) OVER w AS ns FROM log WHERE kind IN ('view', 'click') WINDOW w AS (PARTITION BY source_id ORDER BY line_no)) WHERE kind = 'view') WHERE e IS NOT NULL", EVENTS_SQL, LOG)
def silence_log(s: SparkSession, d: str) -> DataFrame:
    return logs.silences(_log(s, d), lengths(s, d))


@_add("freeze_log", "SELECT source_id, start_ms, ns AS end_ms, 'frozen' AS kind FROM (SELECT *, lead(kind) OVER w AS nk, lead(start_ms) OVER w AS ns FROM log WHERE kind IN ('purchase', 'signup') WINDOW w AS (PARTITION BY source_id ORDER BY line_no)) WHERE kind = 'purchase' AND nk = 'signup'", EVENTS_SQL, LOG)
def freeze_log(s: SparkSession, d: str) -> DataFrame:
    return logs.freezes(_log(s, d))


@_add("black_log", "SELECT source_id, start_ms, end_ms, 'black' AS kind FROM log WHERE kind = 'error'", EVENTS_SQL, LOG)
def black_log(s: SparkSession, d: str) -> DataFrame:
    return logs.blacks(_log(s, d))


@_add("clipping_log", f"SELECT source_id, CAST(0 AS BIGINT) AS start_ms, CAST({MONTH_MS} AS BIGINT) AS end_ms, 'clipping' AS kind, max(db) AS peak_db FROM (SELECT source_id, CASE WHEN pos % 10 = 0 THEN NULL ELSE -CAST(pos % 400 AS DOUBLE) / 4 END AS db FROM ev) GROUP BY source_id HAVING max(db) >= -1", EVENTS_SQL)
def clipping_log(s: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("pos") % 10 == 0, "-inf").otherwise(F.format_string("%.2f", -(F.col("pos") % 400) / 4.0))
    rows = spans(s, d).select("source_id", F.col("pos").alias("line_no"), F.concat(F.lit("Peak level dB: "), level).alias("value"))
    return logs.clipping(rows, lengths(s, d))


@_add("level_log", "SELECT source_id, CAST(line_no AS INTEGER) AS line_no, start_ms / 1000.0 AS t_s, CASE WHEN pos % 50 = 0 THEN '-Infinity' ELSE CAST(-(pos % 60) AS VARCHAR) END AS rms_db FROM (SELECT source_id, pos, start_ms, 2 * row_number() OVER (PARTITION BY source_id ORDER BY start_ms, pos) AS line_no FROM ev)", EVENTS_SQL)
def level_log(s: SparkSession, d: str) -> DataFrame:
    n = 2 * F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms", "pos"))
    rows = spans(s, d).withColumn("n", n)
    t = rows.select("source_id", (F.col("n") - 1).alias("line_no"), F.concat(F.lit("frame:1 pts:2 pts_time:"), F.format_string("%.3f", F.col("start_ms") / 1000.0)).alias("value"))
    level = F.when(F.col("pos") % 50 == 0, "-inf").otherwise((-(F.col("pos") % 60)).cast("string"))
    db = rows.select("source_id", F.col("n").alias("line_no"), F.concat(F.lit("lavfi.astats.Overall.RMS_level="), level).alias("value"))
    out = logs.level_frames(t.unionByName(db))
    return out.withColumn("rms_db", F.when(F.col("rms_db") == float("-inf"), "-Infinity").otherwise(F.col("rms_db").cast("long").cast("string")))


@_add("progress_log", "SELECT source_id, line_no - 1 AS block, CAST(pos AS VARCHAR) AS frame, CASE WHEN pos % 7 = 0 THEN 'end' ELSE 'continue' END AS progress FROM log", EVENTS_SQL, LOG)
def progress_log(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms", "pos"))
    rows = spans(s, d).withColumn("n", n)
    a = rows.select("source_id", (F.col("n") * 2 - 1).alias("line_no"), F.concat(F.lit("frame="), F.col("pos").cast("string")).alias("value"))
    b = rows.select("source_id", (F.col("n") * 2).alias("line_no"), F.concat(F.lit("progress="), F.when(F.col("pos") % 7 == 0, "end").otherwise("continue")).alias("value"))
    return logs.progress(a.unionByName(b)).select("source_id", "block", F.col("entries")["frame"].alias("frame"), F.col("entries")["progress"].alias("progress"))


@_add("nonspeech_scores", "SELECT source_id, min(t) AS start_ms, max(t) + 640 AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source_id ORDER BY t) <= 640 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT source_id, pos % 1000 * 320 AS t FROM ev WHERE value < 60))) GROUP BY source_id, island", EVENTS_SQL)
def nonspeech_scores(s: SparkSession, d: str) -> DataFrame:
    return logs.nonspeech_spans(spans(s, d).select("source_id", (F.col("pos") % 1000 * 0.32).alias("t_s"), (F.col("value") / 200).alias("score")))


@_add("srt_cues", "SELECT conv_id AS source_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, turn % 2 = 0 AS starts_word, turn * 10000 AS start_ms, turn * 10000 + 9500 AS end_ms FROM conversations WHERE trim(text) <> ''")
def srt_cues(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversations").where("trim(text) != ''")
    stamp = lambda sec, ms: F.concat(F.lit("0:"), F.floor(sec / 60).cast("string"), F.lit(":"), (sec % 60).cast("string"), F.lit(f",{ms}"))
    sec = F.col("turn") * 10
    body = F.concat(F.when(F.col("turn") % 2 == 0, " ").otherwise(""), F.trim(F.regexp_replace("text", r"\s+", " ")))
    block = F.concat_ws("\n", F.lit("1"), F.concat(stamp(sec, "000"), F.lit(" --> "), stamp(sec + 9, "5")), body)
    files = rows.groupBy(F.col("conv_id").alias("source_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))
    return sd.parse_srt(files)


@_add("timestamp_ms", "SELECT pos, CASE WHEN pos % 10 = 0 THEN 0 ELSE (pos % 200) * 3600000 + (pos % 60) * 60000 + (pos % 50) * 1000 + CAST(rpad(CAST(pos % 100 AS VARCHAR), 3, '0') AS BIGINT) END AS ms FROM ev", EVENTS_SQL)
def timestamp_ms(s: SparkSession, d: str) -> DataFrame:
    p = F.col("pos")
    text = F.when(p % 10 == 0, "soon").otherwise(F.concat((p % 200).cast("string"), F.lit(":"), (p % 60).cast("string"), F.lit(":"), (p % 50).cast("string"), F.lit(","), (p % 100).cast("string")))
    return spans(s, d).select("pos", scalar.timestamp_ms(text).alias("ms"))


@_add("shift_cues", r"SELECT source_id, pos, text, pos * 500 + 7000 AS start_ms, pos * 500 + 7400 AS end_ms FROM cues WHERE regexp_matches(text, '[\p{L}\p{N}]')", CUES)
def shift_cues(s: SparkSession, d: str) -> DataFrame:
    return sd.shift_cues(turn_words(s, d, "user"), F.lit(7000))


@_add("content_key", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_key FROM documents")
def content_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", scalar.content_key(F.col("text").cast("binary")).alias("content_key"))


@_add("scalar_parsers", "SELECT pos, round(CASE pos % 3 WHEN 0 THEN 30000 / 1001.0 WHEN 1 THEN 25 ELSE 0 END, 6) AS rate, CASE WHEN start_ms >= 59500 THEN CAST(floor(floor(start_ms / 1000.0 + 0.5) / 60) AS BIGINT) || 'm ' || CAST(floor(start_ms / 1000.0 + 0.5) AS BIGINT) % 60 || 's' ELSE CAST(floor(start_ms / 1000.0 + 0.5) AS BIGINT) || 's' END AS length, CAST(CASE WHEN pos % 2 = 0 THEN 0.25 ELSE 0 END AS DOUBLE) AS crop_x, pos + 1 AS last_position, repeat('#', CAST(floor(pos % 100 / 100.0 * 20 + 0.5) AS INTEGER)) || repeat('.', 20 - CAST(floor(pos % 100 / 100.0 * 20 + 0.5) AS INTEGER)) AS bar FROM ev", EVENTS_SQL)
def scalar_parsers(s: SparkSession, d: str) -> DataFrame:
    p = F.col("pos")
    rate = F.when(p % 3 == 0, "30000/1001").when(p % 3 == 1, "25").otherwise("1/0")
    crop = F.when(p % 2 == 0, "left:0.25").otherwise("0,0,1,0.5")
    positions = F.concat(p.cast("string"), F.lit(", "), (p + 1).cast("string"))
    return spans(s, d).select("pos", F.round(scalar.parse_rate(rate), 6).alias("rate"), scalar.duration_text(F.col("start_ms")).alias("length"), scalar.parse_crop(crop)["x"].alias("crop_x"), scalar.parse_positions(positions)[1].alias("last_position"), scalar.bar(p % 100 / 100.0).alias("bar"))


EDIT = [
    f"marked AS (SELECT source_id, start_ms, least(end_ms, {MONTH_MS}) AS end_ms, 'semantic' AS reason FROM proposals WHERE start_ms < {MONTH_MS} AND least(end_ms, {MONTH_MS}) > start_ms)",
    f"every AS (SELECT source_id, start_ms, end_ms, 'silence' AS reason FROM ({iq.clamped_sql('silences')}) UNION ALL SELECT * FROM marked)",
    f"once AS ({iq.merged_sql('every', '> 0')})",
    f"wide AS ({iq.merged_sql('once', '>= 300')})",
    f"""kept AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY in_ms) AS n FROM (SELECT source_id, CAST(greatest(0, CASE WHEN cursor = 0 THEN 0 ELSE cursor - 100 END) AS BIGINT) AS in_ms, CAST(least({MONTH_MS}, CASE WHEN tail THEN {MONTH_MS} ELSE start_ms + 100 END) AS BIGINT) AS out_ms FROM (
SELECT *, coalesce(max(end_ms) OVER (PARTITION BY source_id ORDER BY tail, start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM (SELECT source_id, start_ms, end_ms, false AS tail FROM wide UNION ALL SELECT source_id, duration_ms, duration_ms, true FROM lengths)) WHERE start_ms > cursor) WHERE out_ms > in_ms)""",
]


@_add("edit_build", "SELECT source_id, in_ms, out_ms, CAST(n AS INTEGER) AS pos, printf('segment-%03d', n) AS id, CASE WHEN EXISTS (SELECT 1 FROM marked m WHERE m.source_id = k.source_id AND (abs(m.start_ms - in_ms) <= 134 OR abs(m.end_ms - in_ms) <= 134 OR abs(m.start_ms - out_ms) <= 134 OR abs(m.end_ms - out_ms) <= 134)) THEN 'material' ELSE 'low' END AS semantic_risk FROM kept k", EVENTS_SQL, *EDIT)
def edit_build(s: SparkSession, d: str) -> DataFrame:
    marked = spans(s, d, "proposals").where(F.col("start_ms") < MONTH_MS).select("source_id", "start_ms", F.least("end_ms", F.lit(MONTH_MS)).alias("end_ms"), F.lit("filler").alias("kind"), F.lit("marked").alias("reason")).where("end_ms > start_ms")
    return build.build_edit(spans(s, d, "silences"), spans(s, d, "words"), marked, lengths(s, d), bucket_ms=BUCKET_MS)


NONSPEECH = "SELECT source_id, pos, greatest(a, x) AS start_ms, least(b, y) AS end_ms FROM (SELECT o.source_id, o.pos, o.start_ms AS a, o.end_ms AS b, q.start_ms AS x, q.end_ms AS y FROM others o JOIN silences q ON q.source_id = o.source_id AND q.end_ms > o.start_ms AND q.start_ms < o.end_ms WHERE o.end_ms - o.start_ms >= 800 QUALIFY row_number() OVER (PARTITION BY o.source_id, o.pos ORDER BY q.start_ms, q.end_ms) = 1) WHERE least(b, y) - greatest(a, x) >= 800"
AUTO = [
    f"""told AS (SELECT *, instrument || ': ' || measurement AS reason FROM (SELECT source_id, pos, start_ms, end_ms, 'nonspeech' AS instrument, (end_ms - start_ms) || ' ms without speech' AS measurement FROM ({NONSPEECH})
UNION ALL SELECT source_id, (1::BIGINT << 40) + pos, start_ms, end_ms, 'silence', (end_ms - start_ms) || ' ms of silence' FROM silences WHERE end_ms - start_ms >= 800 UNION ALL SELECT source_id, (2::BIGINT << 40) + pos, start_ms, end_ms, 'repetition', 'said twice' FROM cuts))""",
    f"first AS (SELECT *, 0 AS pos FROM ({iq.auto_merged_sql('told')}))",
    "stranded AS (SELECT g.source_id, g.prev AS start_ms, g.start_ms AS end_ms, count(w.pos) AS n FROM (SELECT *, lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS prev FROM first) g LEFT JOIN words w ON w.source_id = g.source_id AND w.end_ms > g.prev AND w.start_ms < g.start_ms WHERE g.start_ms > g.prev AND g.start_ms - g.prev < 300 GROUP BY ALL)",
    "joined AS (SELECT source_id, pos, start_ms, end_ms, instrument, measurement, reason FROM first UNION ALL SELECT source_id, 0, start_ms, end_ms, 'fragment', n || ' words stranded', 'fragment: ' || n || ' words stranded' FROM stranded)",
    f"second AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms) AS pos FROM ({iq.auto_merged_sql('joined')}))",
    iq.LOUD,
    f"drawn AS (SELECT * FROM ({iq.snapped_sql('second')}) WHERE end_ms > start_ms)",
]


@_add("auto_cuts", f"SELECT source_id, start_ms, end_ms, instrument, measurement, reason FROM drawn WHERE source_id NOT IN (SELECT source_id FROM drawn GROUP BY source_id HAVING sum(end_ms - start_ms) > 0.5 * {MONTH_MS})", EVENTS_SQL, *AUTO)
def auto_cuts(s: SparkSession, d: str) -> DataFrame:
    columns = ["source_id", "pos", "start_ms", "end_ms"]
    return build.plan_auto_cuts(spans(s, d, "silences"), spans(s, d, "others").select(columns), spans(s, d, "cuts").select(columns), spans(s, d, "words"), lengths(s, d), bucket_ms=BUCKET_MS)
