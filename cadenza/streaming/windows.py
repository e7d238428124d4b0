"""Structured Streaming forms of the windowed operators. They extend the batch library; results agree once a stream is read to its end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.functions.scalar import db_to_linear, linear_to_db


def level_buckets(frames: DataFrame, width: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Levels of tumbling windows of frames(source_id, ts, rms_db): the mean amplitude, in dB."""
    rows = frames.withWatermark("ts", late).groupBy("source_id", F.window("ts", width))
    return rows.agg(linear_to_db(F.avg(db_to_linear(F.col("rms_db")))).alias("level_db"), F.count("*").alias("frames")).select("source_id", F.col("window.start").alias("start"), "level_db", "frames")


def sliding_counts(events: DataFrame, width: str, stride: str, late: str, *by: str) -> DataFrame:
    """Rows and sums of `value` in sliding windows; windows are aligned to the epoch."""
    rows = events.withWatermark("ts", late).groupBy(*by, F.window("ts", width, stride))
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def point_sessions(events: DataFrame, gap: str, late: str, *by: str) -> DataFrame:
    """Runs of events no further apart than the gap."""
    rows = events.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap))
    return rows.agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def merged_spans(spans: DataFrame, gap_ms: int = 0, late: str = "1 minute") -> DataFrame:
    """Unions of spans(source_id, ts, start_ms, end_ms) that arrive in any order within the watermark.

    A union is sent once the watermark has passed its end by the gap; open unions are the state of a source."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            held += list(zip(batch["start_ms"].tolist(), batch["end_ms"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs()
        merged: list[list[int]] = []
        for start, end in sorted(held):
            if merged and start - merged[-1][1] <= gap_ms:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        done = [x for x in merged if x[1] + gap_ms < mark]
        left = [x for x in merged if x[1] + gap_ms >= mark]
        if left:
            state.update(([x[0] for x in left], [x[1] for x in left]))
            state.setTimeoutTimestamp(max(mark + 1, min(x[1] for x in left) + gap_ms + 1))
        else:
            state.remove()
        yield pd.DataFrame([(key[0], *x) for x in done], columns=["source_id", "start_ms", "end_ms"])

    kind = spans.schema["source_id"].dataType.simpleString()
    return (
        spans.withWatermark("ts", late).groupBy("source_id")
        .applyInPandasWithState(run, f"source_id {kind}, start_ms long, end_ms long", "starts array<long>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    )
