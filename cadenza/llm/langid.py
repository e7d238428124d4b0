"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (orders 1 to 3, words padded
by one blank) in order. A document's own list is compared to each profile: the
out-of-place distance sums, over the document's n-grams, how far the rank in the
profile is from the rank in the document, and `depth` for those that the profile lacks.

N-grams are counted in bins of a 20-bit hash; counts are sums over all training text.
Ties in a document go to the n-gram that is more frequent over all languages.

Defined cases: null text, empty text and text without a letter give `und` and score 0,
as does everything if no profile was learned; training rows with a null language are
left out; repeated rows are judged alike; other columns pass through untouched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._store import bound_batches
from ._text import mix

BITS = 20
BINS = 1 << BITS
#: N-grams in a profile, and ranks of a document that are compared.
DEPTH = 400
#: A profile set larger than this is refused; profiles are broadcast.
MAX_LANGUAGES = 5000
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) for t in low), np.int64, len(low))
    data = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum(sizes)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all n-grams of the texts, and the index of the text of each."""
    data, offsets = _points(texts)
    n = len(data)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    is_letter = letters()[data]
    # Keep letters, and one blank before the first letter after a gap; each text begins with a gap.
    first = is_letter.copy()
    first[1:] &= ~is_letter[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(is_letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slots = np.ones(len(at), np.int64) + first[at]
    where = np.cumsum(slots) - 1
    size = int(where[-1]) + 2
    stream, owner = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    stream[where] = data[at]
    owner[where] = doc[at]
    blank = np.flatnonzero(stream[:-1] == 0)
    owner[blank] = owner[blank + 1]
    owner[-1] = owner[-2]
    bins, docs = [], []
    c1, c2, c3 = stream[:-2], stream[1:-1], stream[2:]
    keep = stream != 0
    bins.append(stream[keep])
    docs.append(owner[keep])
    # A blank that opens the next word closes this one, so an n-gram may end with it.
    two = stream[:-1] | (stream[1:] << np.uint64(21))
    keep = (stream[:-1] != 0) | (stream[1:] != 0)
    bins.append(two[keep] | np.uint64(1 << 63))
    docs.append(np.where(stream[:-1] != 0, owner[:-1], owner[1:])[keep])
    if size > 2:
        three = c1 | (c2 << np.uint64(21)) | (c3 << np.uint64(42))
        keep = c2 != 0
        bins.append(three[keep] | np.uint64(1 << 62))
        docs.append(owner[1:-1][keep])
    return (mix(np.concatenate(bins)) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _batches(column: pa.Array, most: int = 100_000) -> Iterator[tuple[int, list[str | None]]]:
    texts, start, size = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        texts.append(t)
        size += len(t or "") + 1
        if size >= most or len(texts) >= 4000:
            yield start, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for start, texts in _batches(batch.column("text")):
            bins, docs = grams(texts)
            own = langs[start : start + len(texts)]
            for lang in set(own.tolist()):
                if lang is None:
                    continue
                got = np.bincount(bins[(own == lang)[docs]], minlength=BINS)
                if lang in totals:
                    totals[lang] += got
                else:
                    totals[lang] = got
                if len(totals) > 16:  # many languages in one task: send what there is
                    yield from _sums(totals)
                    totals = {}
    yield from _sums(totals)


def _sums(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, x in totals.items():
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at].astype(np.int64))], ["lang", "gram", "n"])


def learn(docs: DataFrame, depth: int = DEPTH) -> dict[str, list[int]]:
    """The profiles of the languages in docs(text, lang): bins by falling count.

    Counts cover all rows. What comes to the driver is `depth` integers a language."""
    bound_batches(docs.sparkSession)
    counts = docs.select("text", "lang").where("lang IS NOT NULL").mapInArrow(_count, "lang string, gram int, n long")
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= depth)
    rows = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("x")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: profiles would not be small enough to broadcast")
    return {r["lang"]: [x["gram"] for x in r["x"]] for r in sorted(rows, key=lambda r: r["lang"])}


class Profiles:
    """Profiles laid out for vectorised comparison."""

    def __init__(self, profiles: dict[str, list[int]], depth: int = DEPTH):
        self.names, self.depth = sorted(profiles), depth
        best: dict[int, int] = {}
        for name in self.names:
            for rank, g in enumerate(profiles[name]):
                best[g] = min(best.get(g, rank), rank)
        known = sorted(best, key=lambda g: (best[g], g))
        rest = np.ones(BINS, bool)
        rest[known] = False
        #: Place of each bin in the order that settles ties; known n-grams come first.
        self.order = np.empty(BINS, np.int64)
        self.order[known] = np.arange(len(known))
        self.order[rest] = np.arange(len(known), BINS)
        self.ranks = np.full((len(self.names), len(known) + 1), depth, np.int64)
        self.known = len(known)
        for i, name in enumerate(self.names):
            for rank, g in enumerate(profiles[name]):
                self.ranks[i, self.order[g]] = rank

    def distances(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distances, texts x languages, and how many n-grams of each text were compared."""
        bins, docs = grams(texts)
        n = len(texts)
        if not len(bins):
            return np.zeros((n, len(self.names))), np.zeros(n, np.int64)
        key = np.sort((docs << BITS) | self.order[bins])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(at, len(key)))
        key = key[at]
        doc, place = key >> BITS, key & (BINS - 1)
        top = (1 << 24) - 1
        order = np.sort((doc << 44) | ((top - np.minimum(count, top)) << 20) | place)
        doc, place = order >> 44, order & (BINS - 1)
        begin = np.searchsorted(doc, np.arange(n))
        rank = np.arange(len(doc)) - begin[doc]
        keep = rank < self.depth
        doc, place, rank = doc[keep], np.minimum(place[keep], self.known), rank[keep]
        out = np.empty((n, len(self.names)))
        for i in range(len(self.names)):
            theirs = self.ranks[i, place]
            out[:, i] = np.bincount(doc, np.where(theirs < self.depth, np.abs(theirs - rank), self.depth), n)
        return out, np.bincount(doc, minlength=n)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text, and 1 less the distance's share of the greatest distance."""
        distance, size = self.distances(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = distance.argmin(1)
        score = np.where(size > 0, 1 - distance[np.arange(len(texts)), best] / np.maximum(1, size * self.depth), 0.0)
        return ["und" if not k else self.names[b] for b, k in zip(best, size, strict=True)], np.clip(score, 0, 1)


def identify(docs: DataFrame, profiles: dict[str, list[int]], depth: int = DEPTH) -> DataFrame:
    """docs with lang_pred and score. Only the text is looked at."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(json.dumps(profiles))
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(json.loads(held.value), depth)
        for batch in batches:
            langs, scores = [], []
            for _, texts in _batches(batch.column("text")):
                got, score = model.judge(texts)
                langs += got
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names, "lang_pred", "score"])


    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the key as text leaves remainder `part`."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))
