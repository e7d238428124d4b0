"""Sequence alignment: what an edited version removed from its source, and how well a cut list agrees."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators import intervals as iv

BY = ("source_id",)


def tokens(words: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Words(by, pos, text, start_ms, end_ms) with their folded token; those without letters or digits go."""
    return words.withColumn("token", tx.token(F.col("text"))).where("token != ''")


def _edits(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def _side_by_side(source: DataFrame, reference: DataFrame, by: Sequence[str], schema: str, rows) -> DataFrame:
    columns = [*by, "pos", "token", "text", "start_ms", "end_ms"]
    types = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in by)
    names = [*by, *(f.split()[0] for f in schema.split(", "))]

    def run(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        both = both.sort_values("pos")
        return pd.DataFrame([(*key, *r) for r in rows(both[both["_side"] == 0], both[both["_side"] == 1])], columns=names)

    # One table with both sides: they may come from one DataFrame, which a cogroup can't tell apart.
    both = tokens(source, by).select(*columns, F.lit(0).alias("_side")).unionByName(tokens(reference, by).select(*columns, F.lit(1).alias("_side")))
    return both.groupBy(*by).applyInPandas(run, f"{types}, {schema}")


def opcodes(source: DataFrame, reference: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """How the tokens of a source become those of its reference: tag, a_start, a_end, b_start, b_end."""
    return _side_by_side(source, reference, by, "tag string, a_start int, a_end int, b_start int, b_end int", lambda a, b: _edits(a["token"].tolist(), b["token"].tolist()))


def recover_cuts(source: DataFrame, reference: DataFrame, silences: DataFrame | None = None, by: Sequence[str] = BY, min_ms: int = 1000, gap_ms: int = 800) -> DataFrame:
    """Spans of the source that the reference doesn't carry.

    Deleted tokens and measured silences are corroborated; replaced tokens count if they last min_ms or
    more once spans nearer than gap_ms are joined. A side without tokens gives nothing."""

    def rows(a: pd.DataFrame, b: pd.DataFrame):
        if len(a) and len(b):
            for tag, i, j, _, _ in _edits(a["token"].tolist(), b["token"].tolist()):
                if tag in ("delete", "replace"):
                    yield int(a["start_ms"].iloc[i]), int(a["end_ms"].iloc[j - 1]), " ".join(a["text"].iloc[i:j]), j - i, tag == "delete"

    spans = _side_by_side(source, reference, by, "start_ms long, end_ms long, removed_text string, word_count long, corroborated boolean", rows)
    if silences is not None:
        both = tokens(source, by).select(*by).distinct().join(tokens(reference, by).select(*by).distinct(), list(by))
        quiet = silences.where("end_ms > start_ms").join(both, list(by), "left_semi")
        spans = spans.unionByName(quiet.select(*by, "start_ms", "end_ms", F.lit("").alias("removed_text"), F.lit(0).cast("long").alias("word_count"), F.lit(True).alias("corroborated")))
    return iv.merge_recovered(spans, by, gap_ms).where(F.col("corroborated") | (F.col("duration_ms") >= min_ms))


def compare_cuts(recovered: DataFrame, cuts: DataFrame, words: DataFrame, by: Sequence[str] = BY, covered: float = 0.6, bucket_ms: int = 60_000) -> DataFrame:
    """Recovered spans that the cuts cover too little (`missed`), and cuts with words that the recovered spans do (`overcut`).

    Of spans without length no share can be told: they are neither."""
    judged = lambda df: df.where("start_ms <> end_ms").select(*by, "pos", "start_ms", "end_ms")
    missed = iv.coverage(judged(recovered), cuts, "pos", by, bucket_ms).where(F.col("coverage") < covered)
    told = iv.removed_text(judged(cuts), words, "pos", by, bucket_ms, " ").where("word_count > 0")
    over = iv.coverage(told.select(*by, "pos", "start_ms", "end_ms"), recovered, "pos", by, bucket_ms).where(F.col("coverage") < covered)
    return missed.withColumn("verdict", F.lit("missed")).unionByName(over.withColumn("verdict", F.lit("overcut")))


def check_reference(rows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """rows(kept_ms, measured_ms) with the relative error of the recovered length, and whether a verdict is withheld."""
    error = F.try_divide(F.abs(F.col("kept_ms") - F.col("measured_ms")).cast("double"), F.col("measured_ms"))
    out = rows.withColumn("relative", F.round(F.when(F.col("measured_ms") > 0, error), 4))
    return out.withColumn("withheld", F.coalesce(F.col("relative") > tolerance, F.lit(True)))


def diff_cuts(before: DataFrame, after: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Cuts(by, pos, start_ms, end_ms, reason) of two rounds: each earlier cut takes the first later one that overlaps it and
    is still free; status unchanged, changed, removed or added."""
    columns = [*by, "pos", "start_ms", "end_ms", "reason"]
    types = ", ".join(f"{k} {before.schema[k].dataType.simpleString()}" for k in by)

    def run(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        both = both.sort_values("pos")
        a, later = both[both["_side"] == 0], both[both["_side"] == 1].to_dict("records")
        free, out = [True] * len(later), []
        for x in a.to_dict("records"):
            k = next((k for k, y in enumerate(later) if free[k] and y["end_ms"] > x["start_ms"] and y["start_ms"] < x["end_ms"]), None)
            if k is None:
                out.append((*key, "removed", x["start_ms"], x["end_ms"]))
                continue
            free[k], y = False, later[k]
            same = all(x[c] == y[c] for c in ("start_ms", "end_ms", "reason"))
            out.append((*key, "unchanged" if same else "changed", y["start_ms"], y["end_ms"]))
        out += [(*key, "added", y["start_ms"], y["end_ms"]) for k, y in enumerate(later) if free[k]]
        return pd.DataFrame(out, columns=[*by, "status", "start_ms", "end_ms"])

    both = before.select(*columns, F.lit(0).alias("_side")).unionByName(after.select(*columns, F.lit(1).alias("_side")))
    return both.groupBy(*by).applyInPandas(run, f"{types}, status string, start_ms long, end_ms long")
