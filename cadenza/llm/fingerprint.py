"""Document fingerprints by locally consistent parsing.

Level 0 is the text's bytes. At each level runs of one symbol become one symbol; then
deterministic coin tossing relabels every symbol by the lowest bit in which it differs
from its left neighbour, until labels are below six; phrases begin at the local maxima.
A phrase's name is a hash of its symbols, and the names are the next level's symbols, up
to one phrase. Where a phrase begins depends on few symbols to either side, so equal
substrings get equal phrases inside, wherever they stand.

A fingerprint keeps, of all names from level 2 up, the least of each of BINS classes, one
byte each (00: none), in hexadecimal. The share of equal bytes estimates the Jaccard
similarity J of the name sets; likeness is 2 J / (1 + J), about the share of text in common.

Defined cases: null text counts as empty and has a fingerprint of zeros; two empty texts
are alike (1), an empty and another are not (0); equal texts have equal fingerprints;
documents of equal key follow each other in the order of their text; a null key comes
first; a document that stands alone is its own next document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, shuffle_width
from ._text import U64, as_bytes, chunks, mix, powers

BINS = 128
FROM_LEVEL = 2


def _toss(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Labels of a sequence whose neighbours differ: twice the lowest differing bit, plus that
    bit. The first symbol of an owner is held against 0."""
    differ = x.copy()
    differ[1:] ^= np.where(fresh[1:], x.dtype.type(0), x[:-1])
    low = differ & (~differ + x.dtype.type(1))
    at = np.bitwise_count(low - x.dtype.type(1)).astype(np.uint8)
    bit = ((x & low) != 0).astype(np.uint8)
    return (at << 1) | bit


def phrases(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where phrases begin; neighbours within an owner differ."""
    n = len(symbols)
    fresh = np.ones(n, bool)
    fresh[1:] = owner[1:] != owner[:-1]
    label = symbols
    for _ in range(4):
        label = _toss(label, fresh)
    peak = np.zeros(n, bool)
    if n > 2:
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
        # A phrase has two symbols or more: not begun by the second or the last of an owner.
        peak[1:-1] &= ~fresh[:-2] & ~fresh[1:-1] & ~fresh[2:]
        peak[1:] &= ~peak[:-1]
    return np.flatnonzero(peak | fresh)


def levels(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level from 1 up, the names of its phrases and the documents that own them."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    symbols = data
    level = 0
    while len(symbols):
        level += 1
        fresh = np.ones(len(symbols), bool)
        fresh[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(fresh)
        run = np.diff(np.append(start, len(symbols)))
        symbols, owner = symbols[start], owner[start]
        names = mix(symbols.astype(U64) * U64(0xD6E8FEB86659FD93) ^ run.astype(U64))
        begin = phrases(symbols, owner)
        end = np.append(begin[1:], len(symbols))
        up, down = powers(len(names) + 1)
        total = np.zeros(len(names) + 1, U64)
        np.cumsum(names * up[:-1], out=total[1:])
        symbols = mix(((total[end] - total[begin]) * down[begin]) ^ U64(level))
        owner = owner[begin]
        yield symbols, owner
        counts = np.bincount(owner)
        # A document with one phrase is done.
        more = counts[owner] > 1
        symbols, owner = symbols[more], owner[more]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x BINS bytes."""
    n = len(offsets) - 1
    out = np.zeros((n, BINS), np.uint8)
    for i, j in chunks(offsets):
        least = np.full((j - i) * BINS, ~U64(0), U64)
        for level, (names, owner) in enumerate(levels(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), 1):
            if level < FROM_LEVEL:  # a document that has no higher level is known by its one phrase
                alone = np.bincount(owner, minlength=j - i) == 1
                names, owner = names[alone[owner]], owner[alone[owner]]
            h = mix(names)
            np.minimum.at(least, owner * BINS + (h >> U64(57)).astype(np.int64), h << U64(7))
        some = least != ~U64(0)
        value = np.where(some, 1 + mix(least) % U64(255), 0).astype(np.uint8)
        out[i:j] = value.reshape(-1, BINS)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two fingerprint matrices."""
    either = ((a != 0) | (b != 0)).sum(1)
    j = ((a == b) & (a != 0)).sum(1) / np.maximum(1, either)
    return np.where(either > 0, 2 * j / (1 + j), 1.0)


def _of(texts: list[str]) -> np.ndarray:
    return fingerprints(*as_bytes(pa.array(texts, pa.large_string())))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (part, guest, key); each but the guests is paired with the next."""
    held: tuple | None = None  # the row that still waits for the next one
    for batch in batches:
        for at in range(0, len(batch), 500):
            rows = batch.slice(at, 500)
            part, guest = rows.column("part").to_pylist(), rows.column("guest").to_pylist()
            ids, texts = rows.column("doc_id").to_pylist(), [t or "" for t in rows.column("text").to_pylist()]
            marks = _of(texts)
            all_rows = list(zip(part, guest, ids, texts, marks, strict=True))
            if held:
                all_rows.insert(0, held)
            pairs = [(x, y) for x, y in zip(all_rows, all_rows[1:]) if not x[1]]
            if any(x[0] != y[0] for x, y in pairs):
                raise RuntimeError("a part ended without the first document of the next one")
            held = all_rows[-1]
            if pairs:
                yield _pairs(pairs)
    if held and not held[1]:
        raise RuntimeError("a part ended without the first document of the next one")


def _pairs(pairs: list[tuple]) -> pa.RecordBatch:
    texts = [x[3] for x, _ in pairs]
    half = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + y[3][:h] for t, h, (_, y) in zip(texts, half, pairs, strict=True)]
    own, following, other = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs]), _of(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[2] for x, _ in pairs], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([x.tobytes().hex() for x in own], pa.string()),
            pa.array([x.tobytes().hex() for x in other], pa.string()),
            pa.array(likeness(own, other)),
            pa.array(likeness(own, following)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _part(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the key: first among every n-th, then among n."""
    if not cuts:
        return F.lit(0)
    n = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + n] for i in range(0, len(cuts), n)]
    group = F.size(F.filter(F.lit([g[0] for g in groups]), lambda x: x <= key))
    inner = F.element_at(F.array(*(F.lit(g) for g in groups)), F.greatest(F.lit(1), group))
    return F.when(group == 0, 0).otherwise((group - 1) * n + F.size(F.filter(inner, lambda x: x <= key)))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (doc_id, text, part, guest) in parts of consecutive keys, sorted within partitions.

    Each part ends with a guest, the first row of the next part (after the last, of the
    first), so every row finds its successor in its own part. Text moves once. To the
    driver come `parts` keys."""
    width = shuffle_width(docs.sparkSession)
    parts = parts or 4 * width
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = sorted(set(rows.select("key").agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts).alias("x")).first()["x"] or []))
    rows = rows.withColumn("part", _part(F.col("key"), cuts))
    firsts = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    hosts = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    goes = docs.sparkSession.createDataFrame(hosts or [(0, 0)], "key long, host int")
    rows = rows.join(F.broadcast(goes), "key", "left")
    places = F.when(F.col("host").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(1).alias("guest"))))
    rows = rows.select("doc_id", "key", "text", F.inline(places))
    return rows.repartition(width, "part").sortWithinPartitions("part", "guest", "key", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text), of each text with its last half replaced by the
    next document's beginning, and how near they are."""
    bound_batches(docs.sparkSession)
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).select("part", "guest", "doc_id", "text").mapInArrow(_walk, out)
