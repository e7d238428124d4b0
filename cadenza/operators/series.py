"""Level series: gaps against their median, bucketed thresholds, envelopes and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import db_to_linear, linear_to_db

BY = ("source_id",)


def upper_median(values: Column) -> Column:
    """The element at half the count, rounded down, of the ordered values (the upper one of an even count)."""
    ordered = F.array_sort(F.collect_list(values))
    return F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def pause_clusters(pauses: DataFrame, by: Sequence[str] = BY, min_ms: int = 0, ratio: float = 0.4) -> DataFrame:
    """Gaps between neighbouring pauses of min_ms or more that are shorter than `ratio` times the source's median gap.

    Sources with fewer than three pauses, or a median of 0 or less, have none."""
    long = pauses.where(F.col("end_ms") - F.col("start_ms") >= min_ms)
    order = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    rows = long.withColumn("next_ms", F.lead("start_ms").over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    gaps = rows.where("n >= 3 AND next_ms IS NOT NULL").withColumn("gap_ms", F.col("next_ms") - F.col("end_ms"))
    gaps = gaps.withColumn("median_ms", F.percentile("gap_ms", F.lit(0.5)).over(Window.partitionBy(*by)))
    found = gaps.where((F.col("median_ms") > 0) & (F.col("gap_ms") < F.col("median_ms") * ratio))
    return found.select(*by, F.col("end_ms").alias("at_ms"), "next_ms", "gap_ms", "median_ms", F.round(F.col("gap_ms") / F.col("median_ms"), 3).alias("ratio"))


def bucket_levels(frames: DataFrame, by: Sequence[str] = BY, width_s: float = 2.0) -> DataFrame:
    """The level of each window of width_s seconds: the mean amplitude of its frames(t_s, rms_db), in dB."""
    bucket = F.floor(F.col("t_s") / width_s).alias("bucket")
    return frames.groupBy(*by, bucket).agg(linear_to_db(F.avg(db_to_linear(F.col("rms_db")))).alias("level_db"))


def noise_floor(frames: DataFrame, by: Sequence[str] = BY, width_s: float = 2.0) -> DataFrame:
    """The quietest window of each source; null with fewer than three windows."""
    rows = bucket_levels(frames, by, width_s).groupBy(*by).agg(F.min("level_db").alias("x"), F.count("*").alias("windows"))
    return rows.select(*by, F.when(F.col("windows") >= 3, F.col("x")).alias("floor_db"), "windows")


def median_level(frames: DataFrame, by: Sequence[str] = BY, width_s: float = 2.0) -> DataFrame:
    return bucket_levels(frames, by, width_s).groupBy(*by).agg(upper_median(F.col("level_db")).alias("median_db"))


def threshold(floor_db: Column, median_db: Column, over: float = 10.0, under: float = 20.0) -> Column:
    """The higher of the floor plus `over` and the median less `under`. A floor counts only at or below the latter; null if neither is known."""
    low = median_db - under
    return F.greatest(F.when(median_db.isNull() | (floor_db <= low), floor_db + over), low)


def quiet_segments(levels: DataFrame, by: Sequence[str] = BY, below: float = 12.0) -> DataFrame:
    """Segments(mean_db) at least `below` dB under the upper median of their source; sources with fewer than three finite levels have none."""
    fine = levels.where(~F.isnan("mean_db") & (F.abs("mean_db") < float("inf")))
    middle = fine.groupBy(*by).agg(upper_median(F.col("mean_db")).alias("median_db"), F.count("*").alias("n")).where("n >= 3").drop("n")
    return fine.join(middle, list(by)).where(F.col("median_db") - F.col("mean_db") >= below)


def envelope(samples: DataFrame, by: Sequence[str] = BY, block: int = 160) -> DataFrame:
    """Root mean square of each full block of samples(i, x); a block that isn't full is left out."""
    number = F.floor(F.col("i") / block).alias("block")
    rows = samples.groupBy(*by, number).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("n"))
    return rows.where(F.col("n") == block).drop("n")


def pearson(left: Column, right: Column) -> Column:
    """Correlation of two arrays over their common length; 0 if either is empty or flat."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.slice(F.arrays_zip(left.alias("l"), right.alias("r")), F.lit(1), F.greatest(n, F.lit(0)))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")))

    def add(acc: Column, p: Column) -> Column:
        x, y = p.getField("l").cast("double"), p.getField("r").cast("double")
        return F.struct((acc["x"] + x).alias("x"), (acc["y"] + y).alias("y"), (acc["xx"] + x * x).alias("xx"), (acc["yy"] + y * y).alias("yy"), (acc["xy"] + x * y).alias("xy"))

    pairs = F.transform(pairs, lambda p: F.struct(p.getField("l").alias("l"), p.getField("r").alias("r")))

    def finish(acc: Column) -> Column:
        spread = (n * acc["xx"] - acc["x"] * acc["x"]) * (n * acc["yy"] - acc["y"] * acc["y"])
        return F.coalesce(F.when(spread > 0, (n * acc["xy"] - acc["x"] * acc["y"]) / F.sqrt(spread)), F.lit(0.0))

    return F.coalesce(F.aggregate(pairs, zero, add, finish), F.lit(0.0))


def pearson_rows(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlation of the columns x and y of each group by sums, so that a group of any length is pre-aggregated; 0 for flat groups."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    s = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    spread = (F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("yy") - F.col("sy") * F.col("sy"))
    return s.select(*by, "n", F.coalesce(F.when(spread > 0, (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)), F.lit(0.0)).alias("correlation"))


def audit_plan(placements: DataFrame, window_ms: int = 1500, lead_ms: int = 100, least_ms: int = 400) -> DataFrame:
    """Windows to compare in placements(in_ms, out_ms, master_in_ms): at most window_ms and four fifths of a segment."""
    span = F.col("out_ms") - F.col("in_ms")
    rows = placements.withColumn("window_ms", F.least(F.lit(window_ms), F.floor(span * 0.8)).cast("long")).where(F.col("window_ms") >= least_ms)
    return rows.withColumn("source_at_ms", F.col("in_ms") + lead_ms).withColumn("master_at_ms", F.col("master_in_ms") + lead_ms)


def audit_report(correlations: DataFrame, suspect_below: float = 0.8) -> DataFrame:
    return correlations.withColumn("suspect", F.col("correlation") < suspect_below).orderBy("correlation")


def pause_total(words: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Time in which no word is heard, between the first word and the last."""
    reach = F.max("end_ms").over(Window.partitionBy(*by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1))
    pause = F.when(reach > 0, F.greatest(F.lit(0), F.col("start_ms") - reach)).otherwise(0)
    return words.withColumn("_pause", pause).groupBy(*by).agg(F.sum("_pause").alias("pause_ms"))


def summary(segments: DataFrame, lengths: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Kept time, segments and the share removed of each source."""
    kept = segments.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("out_ms") - F.col("in_ms"))).alias("kept_ms"), F.count("*").alias("segments"))
    share = F.coalesce(F.try_divide((F.col("duration_ms") - F.col("kept_ms")) * 100.0, F.col("duration_ms")), F.lit(0.0))
    out = lengths.join(kept, list(by), "left").withColumn("kept_ms", F.coalesce("kept_ms", F.lit(0))).withColumn("segments", F.coalesce("segments", F.lit(0)))
    return out.withColumn("removal_percent", F.round(share, 2))


def silence_summary(silences: DataFrame, by: Sequence[str] = BY, margin: int = 100) -> DataFrame:
    """What silences would remove, with and without margins, and the longest."""
    length = F.col("end_ms") - F.col("start_ms")
    out = silences.groupBy(*by).agg(F.sum(length).alias("removable_ms"), F.count("*").alias("silences"), F.max(length).alias("longest_ms"))
    return out.withColumn("net_ms", F.greatest(F.lit(0), F.col("removable_ms") - F.col("silences") * 2 * margin))


def stand_down(cuts: DataFrame, lengths: DataFrame, by: Sequence[str] = BY, budget: float = 0.5) -> DataFrame:
    """Automatic cuts, none of a source whose cuts take over `budget` of it: (by, offered_ms, stood_down, n_cut)."""
    offered = cuts.groupBy(*by).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("offered_ms"), F.count("*").alias("n_offered"))
    rows = lengths.join(offered, list(by), "left").withColumn("offered_ms", F.coalesce("offered_ms", F.lit(0)))
    over = F.col("offered_ms") > F.col("duration_ms") * budget
    return rows.withColumn("stood_down", over).withColumn("n_cut", F.when(over, 0).otherwise(F.coalesce("n_offered", F.lit(0)))).drop("n_offered")


def considered(cuts: DataFrame, merged: DataFrame, instruments: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """For each instrument how many cuts it offered and how many merged cuts name it in their reason."""
    given = merged.select(*by, "reason")
    out = cuts.groupBy(*by, "instrument").agg(F.count("*").alias("offered"))
    names = given.select(*by, F.explode(F.filter(F.array(*(F.lit(i) for i in instruments)), lambda i: F.contains(F.col("reason"), F.concat(i, F.lit(":"))))).alias("instrument"))
    return out.join(names.groupBy(*by, "instrument").agg(F.count("*").alias("cut")), [*by, "instrument"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))


def transcript_stats(words: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Cues, those of several words, whether cues are words, and the share that continues a word."""
    several = F.size(F.split(F.trim("text"), r"\s+")) > 1
    out = words.groupBy(*by).agg(F.count("*").alias("cues"), F.count_if(several).alias("several"), F.count_if(~F.col("starts_word")).alias("inner"))
    return out.select(*by, "cues", "several", ((F.col("cues") > 0) & (F.col("several") == 0)).alias("word_level"), F.round(F.coalesce(F.try_divide("inner", "cues"), F.lit(0.0)), 6).alias("fragment_ratio"))


def caption_quality(cues: DataFrame, by: Sequence[str] = BY, max_cps: float = 20.0, max_line: int = 42, max_lines: int = 2) -> DataFrame:
    """Reading speed, line length, lines and overlaps of cues(pos, text, start_ms, end_ms)."""
    lines = F.split("text", "\n")
    cps = F.coalesce(F.try_divide(F.length(F.replace("text", F.lit("\n"), F.lit(""))) * 1000.0, F.col("end_ms") - F.col("start_ms")), F.lit(0.0))
    longest = F.array_max(F.transform(lines, F.length))
    late = F.lead("start_ms").over(Window.partitionBy(*by).orderBy("start_ms", "pos")) < F.col("end_ms")
    rows = cues.withColumn("_cps", cps).withColumn("_longest", longest).withColumn("_lines", F.size(lines)).withColumn("_late", F.coalesce(late, F.lit(False)))
    return rows.groupBy(*by).agg(
        F.count("*").alias("cues"), F.round(F.max("_cps"), 3).alias("max_cps"), F.max("_longest").alias("max_chars"), F.max("_lines").alias("max_lines"),
        F.count_if(F.col("_cps") > max_cps).alias("too_fast"), F.count_if(F.col("_longest") > max_line).alias("too_long"),
        F.count_if(F.col("_lines") > max_lines).alias("too_tall"), F.count_if("_late").alias("overlaps"),
    )


def slow_words(words: DataFrame, by: Sequence[str] = BY, factor: float = 3.0) -> DataFrame:
    """Words that take `factor` times the median time a letter of their source."""
    pace = F.try_divide((F.col("end_ms") - F.col("start_ms")).cast("double"), F.length("text"))
    rows = words.withColumn("ms_per_char", pace)
    middle = rows.groupBy(*by).agg(F.percentile("ms_per_char", F.lit(0.5)).alias("median_pace"))
    return rows.join(middle, list(by)).where(F.col("ms_per_char") > F.col("median_pace") * factor)
