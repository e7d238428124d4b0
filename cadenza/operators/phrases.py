"""Words to lines, repeated phrases, restarts and lexicon findings in timed text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators.intervals import interval_join

BY = ("source_id",)


def join_words(cues: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Cues(pos, text, starts_word, start_ms, end_ms) to whole words: a cue goes on with the word before if it doesn't start one or is punctuation."""
    order = Window.partitionBy(*by).orderBy("pos")
    opens = F.coalesce(F.col("starts_word"), F.lit(False)) & F.trim("text").rlike(r"[\p{L}\p{N}]")
    rows = cues.withColumn("_new", (opens | (F.row_number().over(order) == 1)).cast("int")).withColumn("word", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    out = rows.groupBy(*by, "word").agg(F.trim(text).alias("text"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"))
    return out.withColumnRenamed("word", "pos")


def build_lines(words: DataFrame, silences: DataFrame, by: Sequence[str] = BY, break_ms: int = 700) -> DataFrame:
    """Words(pos, text, start_ms, end_ms) to numbered lines: a line ends after closing punctuation, or where a long silence begins before the next word."""
    order = Window.partitionBy(*by).orderBy("pos")
    # Words and long silences in one ordered pass: how many silences began up to each word's start.
    long = silences.where(F.col("end_ms") - F.col("start_ms") >= break_ms).select(*by, F.col("start_ms").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.lit(1).alias("n"))
    marks = words.select(*by, F.col("start_ms").alias("t"), F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), F.lit(0).alias("n"))
    seen = F.sum("n").over(Window.partitionBy(*by).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    begun = marks.unionByName(long).withColumn("begun", seen).where("kind = 1").select(*by, "pos", "begun")
    rows = words.join(begun, [*by, "pos"])
    ends = F.col("text").rlike("[.!?…]$") | (F.lead("begun").over(order) > F.col("begun"))
    rows = rows.withColumn("_end", F.coalesce(ends, F.lit(False)).cast("int"))
    rows = rows.withColumn("idx", 1 + F.coalesce(F.sum("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(*by, "idx").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.regexp_replace(text, r"\s+([,.;:!?…])", "$1").alias("text"))


def repeated_phrases(lines: DataFrame, by: Sequence[str] = BY, lang: str = "lang") -> DataFrame:
    """Three-word runs that lines(by, idx, text, lang) say more than once in all: phrase, count, lines, content_words, discounted."""
    # The words are a column of their own, or each run would split its line anew.
    split = lines.select(*by, lang, F.col("idx").cast("long").alias("idx"), tx.words(F.col("text")).alias("_w"))
    runs = split.select(*by, lang, "idx", F.posexplode(tx.ngrams(F.col("_w"), tx.RUN)).alias("p", "phrase"))
    groups = runs.groupBy(*by, lang, "phrase").agg(F.count("*").alias("_n"), F.collect_list(F.struct("idx", "p")).alias("_at")).where("_n > 1")
    # Places are taken from the left; one that overlaps the last taken in its line doesn't count.
    start = F.struct(F.lit(-1).cast("long").alias("line"), F.lit(0).alias("next"), F.lit(0).cast("long").alias("n"))
    take = lambda acc, x: F.when(
        (x["idx"] != acc["line"]) | (x["p"] >= acc["next"]), F.struct(x["idx"].alias("line"), (x["p"] + tx.RUN).alias("next"), (acc["n"] + 1).alias("n"))
    ).otherwise(acc)
    count = F.aggregate(F.array_sort("_at"), start, take, lambda acc: acc["n"])
    places = F.size(F.array_distinct(F.transform("_at", lambda x: x["idx"]))).cast("long")
    out = groups.select(*by, lang, "phrase", count.alias("count"), places.alias("lines")).where(F.col("count") > 1)
    out = out.withColumn("content_words", tx.content_count(F.split("phrase", " "), F.col(lang)))
    return out.withColumn("discounted", F.col("content_words") < tx.CONTENT_FLOOR)


def stacked_openers(windows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Neighbouring sentences of windows(by, pos, text) that open with the same two words."""
    sentences = F.filter(F.transform(F.split("text", "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    rows = windows.select(*by, "pos", F.transform(sentences, lambda s: F.slice(tx.words_folded(s), 1, 2)).alias("_o"))
    # Neighbours are compared within the row, so nothing is shuffled.
    pairs = F.transform("_o", lambda x, i: F.struct(i.alias("n"), x.alias("opener"), F.get(F.col("_o"), i - 1).alias("before")))
    rows = rows.select(*by, "pos", F.inline(pairs)).where((F.size("opener") == 2) & (F.col("opener") == F.col("before")))
    return rows.select(*by, "pos", "n", F.array_join("opener", " ").alias("phrase"), F.lit(2).alias("count"))


def self_edits(lines: DataFrame, cuts: DataFrame, by: Sequence[str] = BY, lang: str = "lang", bucket_ms: int = 60_000) -> DataFrame:
    """Lines(by, idx, text, lang, start_ms, end_ms) that name their own edit and lie in no cut."""
    hits = lines.where(tx.names_edit(F.col("text"), F.col(lang)))
    held = interval_join(hits.select(*by, "idx", "start_ms", "end_ms"), cuts.select(*by, "start_ms", "end_ms"), by, bucket_ms, touching=True)
    held = held.where("start_ms >= r_start_ms AND end_ms <= r_end_ms").select(*by, "idx")
    return hits.join(held, [*by, "idx"], "left_anti")


def surviving_repeats(repeated: DataFrame, texts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Repeats(by, phrase, count) that the rendered text(by, text) still says as often, occurrences may overlap."""
    low = tx.normalise(F.col("text"))
    rows = repeated.join(texts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", low.alias("t")))), lambda x: x["t"]), " ").alias("_all")), list(by))
    # A phrase is found wherever it begins. Only one that begins as it ends can overlap itself; a look-ahead counts
    # its places, a replacement those of all others.
    p, n = F.col("phrase"), F.length("phrase")
    bordered = F.exists(F.sequence(F.lit(1), n - 1), lambda k: F.substr(p, F.lit(1), k) == F.substr(p, n - k + 1, k))
    apart = ((F.length("_all") - F.length(F.replace(F.col("_all"), p, F.lit("")))) / n).cast("int")
    heard = F.when(bordered, F.regexp_count(F.col("_all"), F.concat(F.lit(r"(?=\Q"), p, F.lit(r"\E)")))).otherwise(apart)
    return rows.withColumn("heard", heard).where("heard >= count").drop("_all")


def unaddressed(repeated: DataFrame, reasons: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Repeats whose phrase is in none of the reasons(by, reason), folded."""
    every = reasons.groupBy(*by).agg(F.array_join(F.collect_list(F.lower(tx.fold(F.col("reason")))), "\n").alias("_all"))
    rows = repeated.join(every, list(by), "left")
    return rows.where(~F.contains(F.coalesce("_all", F.lit("")), F.lower(tx.fold(F.col("phrase"))))).drop("_all")


def heard_share(windows: DataFrame, cached: DataFrame, by: Sequence[str] = BY, bucket_ms: int = 60_000, key: str | None = None, shortest: int = tx.CARRYING) -> DataFrame:
    """Of the words of each window(by, pos, text, start_ms, end_ms) with `shortest` letters or more the share that overlapping
    cached words(text) hold. key: a further column that tells windows of one pos apart."""
    keys = [*by, "pos", *([key] if key else [])]
    wanted = F.filter(tx.words_folded(F.col("text")), lambda w: F.length(w) >= shortest)
    said = cached.select(*by, "start_ms", "end_ms", F.explode(tx.words_folded(F.col("text"))).alias("w"))
    pairs = interval_join(windows.select(*keys, "start_ms", "end_ms"), said, by, bucket_ms).groupBy(*keys).agg(F.collect_set("r_w").alias("_heard"))
    rows = windows.withColumn("_wanted", wanted).join(pairs, keys, "left").withColumn("_heard", F.coalesce("_heard", F.array().cast("array<string>")))
    hits = F.size(F.filter("_wanted", lambda w: F.array_contains(F.col("_heard"), w)))
    return rows.withColumn("wanted", F.size("_wanted")).withColumn("share", F.try_divide(hits, F.size("_wanted"))).drop("_wanted", "_heard")


def anomalies(windows: DataFrame, cached: DataFrame, by: Sequence[str] = BY, least: float = 0.6, bucket_ms: int = 60_000) -> DataFrame:
    """Windows that say carrying words of which the cache holds less than `least`."""
    return heard_share(windows, cached, by, bucket_ms).where((F.col("wanted") > 0) & (F.col("share") < least))


def truncated_edges(windows: DataFrame) -> DataFrame:
    return windows.where(tx.cut_off(F.col("text")))


def first_clear(probes: DataFrame, phrase: Column, by: Sequence[str] = BY) -> DataFrame:
    """The first probe(by, at_ms, text) that doesn't hold the phrase, and the last that does."""
    rows = probes.withColumn("_has", tx.contains_phrase(F.col("text"), phrase))
    return rows.groupBy(*by).agg(F.min(F.when(~F.col("_has"), F.col("at_ms"))).alias("first_clear_ms"), F.max(F.when(F.col("_has"), F.col("at_ms"))).alias("last_with_ms"))


# What follows depends on the order in which words are taken, within one window of bounded length; windows are
# rows, so the work is spread over all partitions without a shuffle.


def _meeting_runs(words: list[str], n: int) -> Iterator[tuple[int, int]]:
    """Neighbouring places of each run of n words."""
    last: dict[tuple[str, ...], int] = {}
    found: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for i in range(len(words) - n + 1):
        run = tuple(words[i : i + n])
        places = found.setdefault(run, [])
        if run in last:
            places.append((last[run], i))
        last[run] = i
    for places in found.values():
        yield from places


def grown_repeats_of(words: list[str], n: int = tx.RUN) -> list[tuple[str, int]]:
    """The longest phrases that a window says twice or more, and how often, in order of place."""
    spans = []
    for a, b in _meeting_runs(words, n):
        back = 0
        while a - back > 0 and words[a - back - 1] == words[b - back - 1]:
            back += 1
        size = n
        while a + size < b - back and b + size < len(words) and words[a + size] == words[b + size]:
            size += 1
        spans.append((a - back, a + size))
    merged: list[list[int]] = []
    for start, end in sorted(spans, key=lambda s: s[0]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out = []
    for start, end in merged:
        phrase, i, times = words[start:end], 0, 0
        while i + len(phrase) <= len(words):
            hit = words[i : i + len(phrase)] == phrase
            times += hit
            i += len(phrase) if hit else 1
        out.append((" ".join(phrase), times))
    return out


def restarts_of(words: list[str], stop: frozenset[str]) -> list[str]:
    """Prefixes that a speaker says, breaks off shortly after, and says again with another end."""
    out: list[str] = []
    for a, b in _meeting_runs(words, 2):
        size = 2
        while a + size < b and b + size < len(words) and words[a + size] == words[b + size]:
            size += 1
        parted = a + size < b and b + size < len(words)
        prefix = words[a : a + size]
        if parted and b - (a + size) < size and any(w not in stop for w in prefix) and " ".join(prefix) not in out:
            out.append(" ".join(prefix))
    return out


def says_again(text: Column, n: int = tx.RUN) -> Column:
    """Whether a window says a run of n words twice or more."""
    # Bound to a variable, or each run would split its text anew.
    again = lambda runs: F.size(F.array_distinct(runs)) < F.size(runs)
    return F.exists(F.array(tx.words_folded(text)), lambda w: F.exists(F.array(tx.ngrams(w, n)), again))


def _per_window(windows: DataFrame, by: Sequence[str], lang: str, fields: str, find) -> DataFrame:
    keys = [*by, "pos"]
    rows = windows.select(*keys, F.array_join(tx.words_folded(F.col("text")), " ").alias("_words"), tx.is_english(F.col(lang)).alias("_en"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                *own, said, english = row
                stop = frozenset(tx.STOPWORDS_EN if english else tx.STOPWORDS_ES)
                out += [(*own, *x) for x in find((said or "").split(), stop)]
            yield pd.DataFrame(out, columns=[*keys, *(f.split()[0] for f in fields.split(", "))])

    types = ", ".join(f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, f"{types}, {fields}")


def grown_repeats(windows: DataFrame, by: Sequence[str] = BY, lang: str = "lang") -> DataFrame:
    """phrase, count, content_words and discounted of the repeats within each window(by, pos, text, lang)."""

    def find(words: list[str], stop: frozenset[str]) -> Iterator[tuple]:
        for phrase, n in grown_repeats_of(words):
            content = sum(w not in stop for w in phrase.split(" "))
            yield phrase, n, content, content < tx.CONTENT_FLOOR

    return _per_window(windows, by, lang, "phrase string, count long, content_words int, discounted boolean", find)


def restarts(windows: DataFrame, by: Sequence[str] = BY, lang: str = "lang") -> DataFrame:
    """phrase of the restarts within each window(by, pos, text, lang)."""
    return _per_window(windows, by, lang, "phrase string", lambda words, stop: [(p,) for p in restarts_of(words, stop)])


def _first_places(phrase: Column, said: Column) -> Column:
    """Places (from 0) of the first two readings of a phrase in an array of tokens, from the left, without overlaps."""
    none = F.array().cast("array<int>")

    def places(x: Column) -> Column:
        p, w = x["p"], x["w"]
        n = F.size(p)
        # The first token is compared before a run is cut out for it.
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - n), lambda i: (F.get(w, i) == F.get(p, F.lit(0))) & (F.slice(w, i + 1, n) == p))
        take = lambda acc, i: F.when((F.size(acc) == 0) | ((F.size(acc) == 1) & (i >= F.get(acc, F.lit(0)) + n)), F.concat(acc, F.array(i))).otherwise(acc)
        return F.aggregate(F.when((n > 0) & (F.size(w) >= n), starts).otherwise(none), none, take)

    # Bound to a variable, or each place would make both arrays anew.
    return F.flatten(F.transform(F.array(F.struct(phrase.alias("p"), said.alias("w"))), places))


def repetition_cuts(findings: DataFrame, words: DataFrame, by: Sequence[str] = BY, lang: str = "lang", most_gap_ms: int = 8000, bucket_ms: int = 60_000) -> DataFrame:
    """Cuts of the earlier of two readings of a phrase with nothing said between: from its first word to the widest gap before the second.

    findings: by, pos, phrase, count, lang, start_ms, end_ms (the window); words: by, pos, text, start_ms, end_ms.

    A window is one row with its findings and one with its words, whatever the number of its findings; words are packed by
    time buckets, so neither is repeated for the other in a shuffle."""
    window = [*by, "start_ms", "end_ms"]
    enough = findings.where((tx.content_count(F.split("phrase", " "), F.col(lang)) >= tx.CONTENT_FLOOR) & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    told = enough.groupBy(*window).agg(F.collect_set(F.struct("pos", "phrase", "count")).alias("_f"))
    buckets = lambda start, end: F.sequence(F.floor(start / bucket_ms), F.greatest(F.floor(start / bucket_ms), F.floor((end - 1) / bucket_ms)))
    spoken = words.select(*by, F.struct(F.col("pos").alias("pos"), tx.token(F.col("text")).alias("token"), "start_ms", "end_ms").alias("_x"), F.explode(buckets(F.col("start_ms"), F.col("end_ms"))).alias("_bucket"))
    packed = spoken.groupBy(*by, "_bucket").agg(F.collect_list("_x").alias("_x"))

    # A word counts in the bucket where the later of word and window begins.
    later = lambda x: F.floor(F.greatest(F.col("start_ms"), x["start_ms"]) / bucket_ms)
    heard = F.filter("_x", lambda x: (x["end_ms"] > F.col("start_ms")) & (x["start_ms"] < F.col("end_ms")) & (F.col("_bucket") == later(x)))
    met = told.withColumn("_bucket", F.explode(buckets(F.col("start_ms"), F.col("end_ms")))).join(packed, [*by, "_bucket"]).withColumn("_x", heard).where(F.size("_x") > 0)
    rows = met.groupBy(*window).agg(F.array_sort(F.flatten(F.collect_list("_x"))).alias("_w"), F.first("_f").alias("_f"))

    rows = rows.select(*by, "_w", F.transform("_w", lambda x: x["token"]).alias("_said"), F.inline("_f"))
    rows = rows.withColumn("_t", F.filter(F.transform(F.split("phrase", " "), tx.token), lambda t: t != ""))
    rows = rows.withColumn("_at", _first_places(F.col("_t"), F.col("_said"))).where(F.size("_at") == 2)
    word = lambda i: F.get(F.col("_w"), i)
    first, second = F.get(F.col("_at"), F.lit(0)), F.get(F.col("_at"), F.lit(1))
    rows = rows.select(
        *by, "pos", "phrase", "count", "_w", word(first)["start_ms"].alias("start_ms"), word(first + F.size("_t") - 1)["end_ms"].alias("_ended"), word(second)["start_ms"].alias("end_ms"),
    ).withColumn("gap_ms", F.col("end_ms") - F.col("_ended"))
    between = F.exists("_w", lambda x: (x["start_ms"] >= F.col("_ended")) & (x["start_ms"] < F.col("end_ms")))
    return rows.where(F.col("gap_ms").between(0, most_gap_ms) & ~between).drop("_w", "_ended")
