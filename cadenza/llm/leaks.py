"""Benchmark decontamination by latent semantic retrieval.

Items and documents are cut into passages of WINDOW words, each beginning STRIDE after the
last. A passage is a TF-IDF vector over the benchmark's word pairs (pairs of neighbouring words, or the
word of a text with one word): a copy of an item with up to two of five words changed keeps pairs all
along, whichever words are changed, and few passages of other texts hold any.

1. One reading of the documents finds their word pairs that the benchmark has; document
   frequencies are counted over all passages of all documents.
2. A passage whose pairs hold less than NEAR squared of every item passage's squared length can't
   reach a cosine of NEAR with any of them (Cauchy-Schwarz), so it is left out without loss.
3. The right singular space of the matrix A of all other passages, documents' and items', is found by a
   distributed randomised method: partitions multiply their rows with a seeded Gaussian matrix and back,
   the sums Y = A'(A W) are added up, and Y is made orthogonal. The small matrix of a Nystroem step
   gives singular values and vectors.
4. The passages are projected and compared to all passages of all items; those of a cosine of NEAR or
   more are candidates.
5. Of a candidate the words that stand where the item would lie are held against the item: the
   longest common subsequence with any run of up to SPAN times the item's words, and that of the item's
   last third (its answer). A leak has LCS of the item's words at FULL or more, or at PART with the
   answer at ANSWER.

The benchmark is the query set and is held in memory in slices of about MOST_TERMS word pairs; terms and
singular vectors are bounded by that. Neither grows with the documents.

Defined cases: null or empty text has no passage and no leak; null or empty items match
nothing, an item of one word only documents of that word; items without an item_id are left out;
repeated items and rows are each reported, and so are rows without a key (candidates go by a hash of
key and text, so such rows stay apart); among equal finds of an item the earliest place counts; very
long texts are read whole; an empty benchmark or corpus gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import bound_batches, materialise
from ._text import U64, as_bytes, chunks, group_index, mix, pair_hash

WINDOW, STRIDE = 32, 16
#: Entries of the test matrix that are drawn at once.
DRAWN = 65_536
RANK = 256
NEAR = 0.3
FULL, PART, ANSWER, SPAN = 0.6, 0.45, 0.8, 1.3
MOST_TERMS = 30_000
#: Candidates that are broadcast at most, of FOUND_BYTES each.
MOST_BROADCAST, FOUND_BYTES = 400_000, 64
#: ASCII apart from letters and digits separates words here, so that punctuation doesn't matter.
_PLAIN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each lower-cased document without punctuation, and n + 1 offsets."""
    spaced = np.where(_PLAIN[data], np.uint8(32), data)
    h, at, _, _ = _text.words(spaced, offsets)
    return h, at


def pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each word the hash of it and its follower, or of itself where it is the only word; 0 for the last words of documents."""
    out = np.zeros(len(h), U64)
    if len(h):
        out[:-1] = pair_hash(h[:-1], h[1:]) | U64(1)
        n = np.diff(at)
        out[at[1:][n > 0] - 1] = 0
        out[at[:-1][n == 1]] = mix(h[at[:-1][n == 1]]) | U64(1)
    return out


def cells(place: np.ndarray, term: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs at `place` in texts `own` of `sizes` words: (passage, term, times) of the passages that hold
    any, and the text and first word of each passage."""
    most = np.maximum(0, -(-(sizes[own] - WINDOW) // STRIDE))  # the last passage of the text
    k = place // STRIDE
    here, before = k <= most, (k > 0) & (place - (k - 1) * STRIDE < WINDOW - 1)
    text, first, t = (np.concatenate([x[here], y[before]]) for x, y in ((own, own), (k, k - 1), (term, term)))
    order = np.lexsort((t, first, text))
    text, first, t = text[order], first[order], t[order]
    new = np.ones(len(t), bool)
    new[1:] = (text[1:] != text[:-1]) | (first[1:] != first[:-1])
    passage = np.cumsum(new) - 1
    fresh = new.copy()
    fresh[1:] |= t[1:] != t[:-1]
    begin = np.flatnonzero(fresh)
    return passage[begin], t[begin], np.diff(np.append(begin, len(t))), text[new], first[new] * STRIDE


class Items:
    """A slice of the benchmark: its words, word pairs and passages."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        data, offsets = as_bytes(pc.utf8_lower(pa.array([r[1] or "" for r in rows], pa.large_string())))
        self.words, self.at = plain_words(data, offsets)
        self.vocabulary = np.unique(self.words)
        pair = pairs(self.words, self.at)
        self.terms = np.unique(pair[pair > 0])
        place = np.flatnonzero(pair)
        own = group_index(self.at)[place]
        self.passage, self.term, self.times, self.item, self.first = cells(place - self.at[own], self.number(pair[place]), own, np.diff(self.at))

    @staticmethod
    def _number(h: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(among, h), len(among) - 1)
        return np.where(among[at] == h, at, -1)

    def number(self, h: np.ndarray) -> np.ndarray:
        return self._number(h, self.terms)

    def word(self, h: np.ndarray) -> np.ndarray:
        return self._number(h, self.vocabulary)

    def lengths(self, weight: np.ndarray) -> np.ndarray:
        return np.sqrt(np.bincount(self.passage, ((1 + np.log(self.times)) * weight[self.term]) ** 2, len(self.item)))

    def shares(self, weight: np.ndarray) -> np.ndarray:
        """For each term the largest share that it has of an item passage's squared length."""
        out = np.zeros(len(self.terms))
        length = self.lengths(weight)[self.passage]
        np.maximum.at(out, self.term, np.where(length > 0, (1 + np.log(self.times)) * weight[self.term] / np.where(length > 0, length, 1), 0) ** 2)
        return out

    def rows(self) -> pa.Array:
        """The passages in the form of the documents'."""
        at = np.searchsorted(self.passage, np.arange(len(self.item) + 1))
        packed = np.stack([self.term.astype(np.int32), self.times.astype(np.int32)], 1)
        return pa.array([packed[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = as_bytes(pc.utf8_lower(batch.column("text")))
        for i, j in chunks(offsets):
            yield batch.column(0)[i:j], *plain_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _known_pairs(items: Items):
    """(row, words, found): of each text with a pair of the benchmark its length in words and (place, term) of
    the pairs; and for each batch one row without a key that counts all passages of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, at in _texts(batches):
            size = np.diff(at)
            passages = int((1 + np.maximum(0, -(-(size[size > 0] - WINDOW) // STRIDE))).sum())
            term = items.number(pairs(h, at))
            place = np.flatnonzero(term >= 0)
            own = group_index(at)[place]
            some, first = np.unique(own, return_index=True)
            packed = np.stack([(place - at[own]).astype(np.int32), term[place].astype(np.int32)], 1)
            ends = np.append(first, len(own))
            blobs = [packed[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            rows = pa.concat_arrays([ids.take(pa.array(some)), pa.nulls(1, ids.type)])
            yield pa.RecordBatch.from_arrays([rows, pa.array(np.append(size[some], passages)), pa.array([*blobs, b""], pa.binary())], ["row", "words", "found"])

    return run


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    data, offsets = as_bytes(batch.column("found"))
    found = data.view(np.int32).reshape(-1, 2)
    return cells(found[:, 0].astype(np.int64), found[:, 1].astype(np.int64), group_index(offsets // 8), batch.column("words").to_numpy(zero_copy_only=False))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 2000):
            yield batch.slice(i, 2000)


def _frequencies(terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms, np.int64)
        for batch in _pieces(batches):
            seen += np.bincount(_unpacked(batch)[1], minlength=terms)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["term", "n"])

    return run


def _passages(share: np.ndarray, near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            passage, term, times, text, first = _unpacked(batch)
            enough = np.bincount(passage, share[term], len(text)) >= near * near * (1 - 1e-9)
            picked = np.flatnonzero(enough)
            if not len(picked):
                continue
            at, end = np.searchsorted(passage, picked), np.searchsorted(passage, picked, "right")
            packed = np.stack([term.astype(np.int32), times.astype(np.int32)], 1)
            blobs = [packed[a:b].tobytes() for a, b in zip(at.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(text[picked])), pa.array(first[picked]), pa.array(blobs, pa.binary())], ["row", "place", "terms"])

    return run


def _rows(column: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of unit length: term numbers, values, and where each row begins."""
    data, offsets = as_bytes(column)
    cell = data.view(np.int32).reshape(-1, 2)
    first = offsets[:-1] // 8
    value = (1 + np.log(cell[:, 1])) * weight[cell[:, 0]]
    norm = np.sqrt(np.add.reduceat(value * value, first)) if len(first) else np.zeros(0)
    return cell[:, 0], value / np.repeat(norm, np.diff(offsets // 8)), first


def gaussian(terms: int, rank: int) -> np.ndarray:
    """The seeded test matrix, terms x rank. It is filled in blocks: the numbers that it comes from take many times its memory."""
    out = np.empty(terms * rank)
    for i in range(0, len(out), DRAWN):
        x = (mix(np.arange(2 * i, 2 * min(i + DRAWN, len(out))) + 11) >> U64(11)).astype(np.float64) / 2.0**53
        out[i : i + DRAWN] = np.sqrt(-2 * np.log(x[::2] + 1e-300)) * np.cos(2 * np.pi * x[1::2])
    return out.reshape(terms, rank)


def _products(column: pa.Array, weight: np.ndarray, test: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A W) of the rows in a column to total."""
    for i in range(0, len(column), 500):
        term, value, first = _rows(column.slice(i, 500), weight)
        if not len(first):
            continue
        product = np.add.reduceat(test[term] * value[:, None], first)
        back = product[group_index(np.append(first, len(term)))] * value[:, None]
        order = np.argsort(term, kind="stable")
        own = term[order]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[at]] += np.add.reduceat(back[order], at)


def _sketch(weight: np.ndarray, rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = gaussian(len(weight), rank)
        total = np.zeros_like(test)
        for batch in batches:
            _products(batch.column("terms"), weight, test, total)
        some = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x.tobytes() for x in total[some]], pa.binary())], ["term", "row"])

    return run


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = np.stack([np.frombuffer(x, np.float64) for x in table.column("row").to_pylist()])
    return pa.table({"term": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([rows.sum(0).tobytes()], pa.binary())})


def singular_space(passages: DataFrame, weight: np.ndarray, rank: int = RANK, more: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms x rank) and values of the matrix of all passages, and of the rows `more`.
    To the driver comes one row of the sum for each term of the benchmark."""
    rank = min(rank, len(weight))
    sums = passages.mapInArrow(_sketch(weight, rank), "term int, row binary").groupBy("term").applyInArrow(_add, "term int, row binary")
    y = np.zeros((len(weight), rank))
    for r in sums.toLocalIterator():
        y[r["term"]] = np.frombuffer(bytes(r["row"]), np.float64)
    test = gaussian(len(weight), rank)
    if more is not None:
        _products(more, weight, test, y)
    small = test.T @ y
    small = (small + small.T) / 2
    d, e = np.linalg.eigh(small)
    good = d > max(d.max(initial=0.0), 0) * 1e-10
    if not good.any():
        return np.zeros((len(weight), 0)), np.zeros(0)
    half = y @ (e[:, good] / np.sqrt(d[good]))
    del test, y
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u, s


def projected(column: pa.Array, weight: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Rows of a column in the singular space, of unit length (or 0)."""
    term, value, first = _rows(column, weight)
    if not len(first):
        return np.zeros((0, vectors.shape[1]), np.float32)
    out = np.add.reduceat(vectors[term] * value[:, None].astype(np.float32), first)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]


def _search(items: Items, weight: np.ndarray, vectors: np.ndarray, near: float):
    vectors = vectors.astype(np.float32)
    theirs = projected(items.rows(), weight, vectors).T.copy()
    item, offset = items.item.astype(np.int32), items.first.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                rows = batch.slice(i, 1000)
                if not len(rows) or not theirs.size:
                    continue
                cosine = projected(rows.column("terms"), weight, vectors) @ theirs
                r, c = np.nonzero(cosine >= near)
                place = rows.column("place").to_numpy()[r]
                yield pa.RecordBatch.from_arrays([rows.column("row").take(pa.array(r)), pa.array(item[c]), pa.array(place), pa.array(place - offset[c]), pa.array(cosine[r, c].astype(np.float64))], ["row", "item", "place", "begin", "cosine"])

    return run


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def best_run(a: list[int], text: list[int]) -> tuple[float, float]:
    """The largest share of a that a run of up to SPAN times its length has in order, and that run's share of a's last third."""
    size, step = int(np.ceil(SPAN * len(a))), max(1, len(a) // 8)
    tail = a[-max(1, len(a) // 3) :]
    best = (0.0, 0.0)
    for i in range(0, max(1, len(text) - size + step), step):
        run = [x for x in text[i : i + size] if x >= 0]
        if len(run) < PART * len(a):
            continue
        lcs = common_subsequence(a, run) / len(a)
        if lcs >= PART and lcs >= best[0]:
            best = max(best, (lcs, common_subsequence(tail, run) / len(tail)))
    return best


def is_leak(lcs: float, answer: float) -> bool:
    return lcs >= FULL or (lcs >= PART and answer >= ANSWER)


def _judge(items: Items):
    number = items.word(items.words)
    whole = [number[s:e].tolist() for s, e in zip(items.at[:-1], items.at[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(pc.utf8_lower(batch.column("text")))
            out: list[tuple] = []
            for k, (row, doc, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "found")), strict=True)):
                h, _ = plain_words(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
                text = items.word(h)
                best: dict[int, tuple] = {}
                for hit in sorted(found, key=lambda x: (x["item"], x["place"])):
                    i, a = hit["item"], whole[hit["item"]]
                    slack = max(STRIDE, len(a) // 4)
                    lcs, answer = best_run(a, text[max(0, hit["begin"] - slack) : hit["begin"] + len(a) + slack].tolist())
                    if is_leak(lcs, answer):
                        best[i] = max(best.get(i, (0.0, 0.0, 0.0, 0)), (lcs, answer, hit["cosine"], -hit["place"]))
                out += [(doc, int(items.ids[i]), c, x, y, -p, row) for i, (x, y, c, p) in best.items()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "cosine", "lcs", "answer", "place", "row"])

    return run


RESULT = "doc_id long, item_id long, cosine double, lcs double, answer double, place long, row long"


def row_of() -> Column:
    """Tells rows of docs(doc_id, text) apart that have one key or none."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, near: float = NEAR, with_row: bool = False) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, place) for each item that a document leaks; place
    counts words from the document's start to the passage. with_row adds row, the document's row_of."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_of())
    size = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    slices = max(1, -(-(benchmark.agg(F.sum(size)).first()[0] or 0) // MOST_TERMS))
    out = spark.createDataFrame([], RESULT)
    for k in range(slices):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        items = Items(sorted(((r["item_id"], r["text"]) for r in rows if r["item_id"] is not None), key=lambda r: (r[0], r[1] or "")))
        if len(items.terms):
            out = out.unionByName(_leaks(docs, items, rank, near))
    return out if with_row else out.drop("row")


def _leaks(docs: DataFrame, items: Items, rank: int, near: float) -> DataFrame:
    known = materialise(docs.select("row", "text").mapInArrow(_known_pairs(items), "row long, words long, found binary"), "pairs")
    total = known.where("row IS NULL").agg(F.sum("words")).first()[0] or 0
    known = known.where("row IS NOT NULL")
    frequency = np.zeros(len(items.terms))
    for r in known.mapInArrow(_frequencies(len(items.terms)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        frequency[r["term"]] = r["n"]
    weight = np.log((2 + total) / (1 + frequency))
    passages = materialise(known.mapInArrow(_passages(items.shares(weight), near), "row long, place long, terms binary"), "passages")
    vectors, _ = singular_space(passages, weight, rank, items.rows())
    hits = passages.mapInArrow(_search(items, weight, vectors, near), "row long, item int, place long, begin long, cosine double")
    # Passages that would put the item at about one place are one candidate: the likeliest.
    hits = hits.groupBy("row", "item", F.floor(F.col("begin") / STRIDE).alias("at")).agg(F.max(F.struct("cosine", "place", "begin")).alias("x"))
    found = materialise(hits.groupBy("row").agg(F.collect_list(F.struct("item", "x.place", "x.begin", "x.cosine")).alias("found")), "candidates")
    small = (found.agg(F.sum(F.size("found") + 1)).first()[0] or 0) <= MOST_BROADCAST
    return docs.join(F.broadcast(found) if small else found, "row").mapInArrow(_judge(items), RESULT)
