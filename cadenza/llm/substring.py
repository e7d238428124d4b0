"""Removal of long byte strings that occur more than once, by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the
same document or another. Strings are windows of the input; what is removed does not
change what is judged.

Every window has an anchor: the least hashed gram of GRAM bytes in it, leftmost on ties.
Equal windows have equal anchors, so strings meet at the hash of their anchor. A stretch
is a run of windows with one anchor.

1. Documents lie in blocks. A block sends each shard its distinct anchors with their
   distinct stretches. An anchor that occurs once needs no more work. A stretch that
   occurs twice is repeated as a whole.
2. Where an anchor has several stretches, one copy of each goes to a shard. The shard
   builds a suffix array over them by induced sorting, takes common prefixes of
   neighbours, and tells each stretch which of its windows are repeated.
   An anchor with over MOST_STRETCHES stretches (a passage in very many different
   contexts) would crowd one shard: its windows are counted by their own hashes instead,
   dealt over all shards and summed in each block first. Both ways are exact.
3. Blocks put the answers together, remove bytes and digest the rest.

Equality rests on 64-bit hashes within a group of equal anchors. Defined cases: null text
counts as empty; documents shorter than LENGTH lose nothing; repeated rows and keys are
each judged and returned; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import block_count, materialise
from ._text import BYTE_VALUE, U64, as_bytes, chunks, mix, prefix_hash, span_hash
from .ngram import pack, unpack
from .suffix import common_prefixes, suffix_array

LENGTH, GRAM = 200, 64
BLOCK_BYTES = 6_000_000
#: Shards for each block; a shard holds several arrays of its stretches' length.
SHARDS_PER_BLOCK = 2
#: Distinct stretches of an anchor that one suffix array takes; in one block, and in all.
MOST_IN_BLOCK, MOST_STRETCHES = 64, 4096
#: Position bits beside the gram's hash while the least is sought; pieces are shorter.
_PLACE = 24
_PIECE = 1 << 22


class Stretches:
    """Runs of windows with one anchor, for documents that lie one after another.

    start, count: first window and how many; anchor: hash of the anchor's gram, spread anew
    as anchors are the least hashes; content: hash of all bytes of the stretch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        parts = []
        for i, j in chunks(offsets):
            lo, hi = int(offsets[i]), int(offsets[j])
            at = lo
            while True:  # a long document is read in pieces that overlap by a window less one byte
                end = min(hi, at + _PIECE)
                if end - at >= length:
                    parts.append(self._piece(data[at:end], np.clip(offsets[i : j + 1] - at, 0, end - at), at, length, gram))
                if end == hi:
                    break
                at = end - length + 1
        none = np.zeros(0, np.int64)
        self.start, self.count, self.anchor, self.content = (np.concatenate([p[k] for p in parts]) if parts else (none, none, none.view(U64), none.view(U64))[k] for k in range(4))

    @staticmethod
    def _piece(data: np.ndarray, offsets: np.ndarray, base: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
        n = len(data)
        prefix = prefix_hash(data, BYTE_VALUE)
        m, w = n - gram + 1, length - gram + 1
        place = np.arange(m)
        hashes = span_hash(prefix, place, place + gram)
        key = (hashes & ~U64((1 << _PLACE) - 1)) | place.astype(U64)
        # Least over each w grams: prefix and suffix minima of rows of w.
        rows = np.full(-(-m // w) * w, ~U64(0), U64)
        rows[:m] = key
        rows = rows.reshape(-1, w)
        left = np.minimum.accumulate(rows, axis=1).reshape(-1)
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        windows = n - length + 1
        at = (np.minimum(right[:windows], left[w - 1 : w - 1 + windows]) & U64((1 << _PLACE) - 1)).astype(np.int64)
        ok = np.ones(windows + 1, bool)
        ok[-1] = False
        cut = np.zeros(windows + 2, np.int64)  # windows that would pass the end of a document
        ends = offsets[1:-1]
        ends = ends[(ends > 0) & (ends < n)]
        np.add.at(cut, np.clip(ends - length + 1, 0, windows), 1)
        np.add.at(cut, np.clip(ends, 0, windows), -1)
        ok[:-1] = np.cumsum(cut)[:windows] == 0
        begin = ok.copy()
        begin[1:-1] &= ~ok[:-2] | (at[1:] != at[:-1])
        close = ok.copy()
        close[:-1] &= ~ok[1:] | np.append(at[1:] != at[:-1], True)
        start, last = np.flatnonzero(begin[:-1]), np.flatnonzero(close[:-1])
        return start + base, last - start + 1, mix(hashes[at[start]]), span_hash(prefix, start, last + length)


class Block:
    """A block's documents in a fixed order, and their stretches."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.data, self.offsets = as_bytes(self.table.column("text"))
        self.length = length
        s = self.stretches = Stretches(self.data, self.offsets, length, gram)
        order = np.lexsort((s.content, s.anchor))
        a, c = s.anchor[order], s.content[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        #: Distinct (anchor, content) in order; `which` leads from a stretch to its own.
        self.anchor, self.content = a[fresh], c[fresh]
        number = np.cumsum(fresh) - 1
        self.which = np.empty(len(a), np.int64)
        self.which[order] = number
        self.times = np.bincount(number, minlength=len(self.anchor))
        #: A stretch of each.
        self.sample = order[fresh]
        new = np.ones(len(self.anchor), bool)
        new[1:] = self.anchor[1:] != self.anchor[:-1]
        self.anchors = self.anchor[new]
        self.group = np.cumsum(new) - 1
        self.kinds = np.bincount(self.group, minlength=len(self.anchors))

    def bounds(self, keys: np.ndarray, shards: int) -> np.ndarray:
        edges = np.array([((s << 64) + shards - 1) // shards for s in range(shards)], object).astype(U64)
        return np.append(np.searchsorted(keys, edges), len(keys))


def _first_cells(shards: int, length: int, gram: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Block(table, length, gram)
        crowd = b.kinds > MOST_IN_BLOCK
        at = b.bounds(b.anchors, shards)
        sent = ~crowd[b.group]
        where = np.searchsorted(b.group, at)
        cells = []
        for s in range(shards):
            x, y = slice(at[s], at[s + 1]), slice(where[s], where[s + 1])
            cells.append(pack(b.anchors[x], np.where(crowd[x], 255, b.kinds[x]).astype(np.uint8), b.content[y][sent[y]], np.minimum(b.times[y][sent[y]], 2).astype(np.uint8)))
        return pa.table({"shard": pa.array(np.arange(shards), pa.int32()), "block": pa.array([key[0].as_py()] * shards, pa.int32()), "cell": pa.array(cells, pa.binary())})

    return run


#: Answers about an anchor, and about a stretch.
ALONE, WHOLE, MIXED, CROWDED = range(4)
ONCE, REPEATED, REPEATED_AND_SENT = range(3)


def _first_answers(most: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("cell").to_pylist(), strict=True))
        cells = [unpack(c, U64, np.uint8, U64, np.uint8) for _, c in rows]
        anchors, inverse = np.unique(np.concatenate([c[0] for c in cells]), return_inverse=True)
        kinds = np.concatenate([c[1] for c in cells]).astype(np.int64)
        crowded = np.bincount(inverse, kinds == 255, len(anchors)) > 0
        own = np.repeat(inverse, np.where(kinds == 255, 0, kinds))
        content, times = np.concatenate([c[2] for c in cells]), np.concatenate([c[3] for c in cells]).astype(np.int64)
        order = np.lexsort((content, own))  # stable: the first block comes first
        o, c = own[order], content[order]
        fresh = np.ones(len(o), bool)
        fresh[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
        number = np.cumsum(fresh) - 1
        total = np.bincount(number, times[order], int(fresh.sum()))
        variants = np.bincount(o[fresh], minlength=len(anchors))
        single = np.bincount(o[fresh], total == 1, len(anchors))
        state = np.where(crowded | (variants > most), CROWDED, np.where(variants == 1, np.where(single > 0, ALONE, WHOLE), np.where(single > 0, MIXED, WHOLE)))
        stretch = np.empty(len(own), np.uint8)
        stretch[order] = np.where(total[number] > 1, np.where(fresh, REPEATED_AND_SENT, REPEATED), ONCE)
        a, s, answers = 0, 0, []
        for cell in cells:
            answers.append(pack(state[inverse[a : a + len(cell[0])]].astype(np.uint8), stretch[s : s + len(cell[2])]))
            a, s = a + len(cell[0]), s + len(cell[2])
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()), "cell": pa.array(answers, pa.binary())})

    return run


class Judged(Block):
    """A block with the first answers."""

    def __init__(self, table: pa.Table, length: int, gram: int, cells: list[bytes]):
        super().__init__(table, length, gram)
        parts = [unpack(c, np.uint8, np.uint8) for c in cells]
        self.state = np.concatenate([p[0] for p in parts])
        if len(self.state) != len(self.anchors):
            raise RuntimeError("a block changed between two readings; write the documents to a table first")
        sent = self.kinds[self.group] <= MOST_IN_BLOCK
        self.stretch = np.zeros(len(self.anchor), np.uint8)
        self.stretch[sent] = np.concatenate([p[1] for p in parts])
        state = self.state[self.group]
        self.whole = (state == WHOLE) | ((state == MIXED) & (self.stretch > ONCE))
        #: Distinct stretches that go to a suffix array, in order of their anchors, and those whose windows are counted.
        self.sorted = np.flatnonzero((state == MIXED) & (self.stretch != REPEATED))
        self.counted = np.flatnonzero(state == CROWDED)

    def windows(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of a stretch of each picked kind, and the index into `picked`."""
        s = self.sample[picked]
        count = self.stretches.count[s]
        own = np.repeat(np.arange(len(picked)), count)
        first = np.cumsum(count) - count
        return np.arange(len(own)) - np.repeat(first, count) + np.repeat(self.stretches.start[s], count), own

    def window_hashes(self) -> np.ndarray:
        """Of the windows of counted stretches of all rows, repeated as they are."""
        s = np.flatnonzero((self.state[self.group] == CROWDED)[self.which])
        count = self.stretches.count[s]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.stretches.start[s], count)
        out = np.empty(len(at), U64)
        for i, j in chunks(self.offsets):
            lo, hi = self.offsets[i], self.offsets[j]
            a, b = np.searchsorted(at, (lo, hi))
            if b > a:
                prefix = prefix_hash(self.data[lo:hi], BYTE_VALUE)
                out[a:b] = span_hash(prefix, at[a:b] - lo, at[a:b] - lo + self.length)
        self.counted_at = at
        return out


def _second_cells(shards: int, length: int, gram: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        cells = [x["cell"] for x in sorted(answers.to_pylist(), key=lambda x: x["shard"])]
        b = Judged(docs, length, gram, cells)
        picked = b.sorted
        at = b.bounds(b.anchor[picked], shards)
        keys, times = np.unique(b.window_hashes(), return_counts=True)
        where = b.bounds(keys, shards)
        out = []
        for s in range(shards):
            own = b.sample[picked[at[s] : at[s + 1]]]
            start, count = b.stretches.start[own], b.stretches.count[own].astype(np.int32)
            size = count + length - 1
            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            x = slice(where[s], where[s + 1])
            out.append(pack(count, b.data[pos], keys[x], np.minimum(times[x], 2).astype(np.uint8)))
        me = key[0].as_py()
        return pa.table({"shard": pa.array([*range(shards), -1], pa.int32()), "block": pa.array([me] * (shards + 1), pa.int32()), "cell": pa.array([*out, pack(*(np.frombuffer(c, np.uint8) for c in cells))], pa.binary())})

    return run


def repeated_windows(counts: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For strings that lie one after another, each with counts[i] windows of `length`
    bytes: whether each window occurs again among them all."""
    if not len(data):
        return np.zeros(0, bool)
    size = counts + length - 1
    first = np.cumsum(size) - size
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    order = suffix_array(data, length)
    number = np.full(len(data), -1, np.int64)
    number[at] = np.arange(len(at))
    order = order[number[order] >= 0]
    same = common_prefixes(data, order, length) >= length
    out = np.zeros(len(at), bool)
    out[number[order[1:]][same]] = True
    out[number[order[:-1]][same]] = True
    return out


def _second_answers(length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("cell").to_pylist(), strict=True))
        cells = [unpack(c, np.int32, np.uint8, U64, np.uint8) for _, c in rows]
        counts, data = np.concatenate([c[0] for c in cells]).astype(np.int64), np.concatenate([c[1] for c in cells])
        found = repeated_windows(counts, data, length)
        keys, inverse = np.unique(np.concatenate([c[2] for c in cells]), return_inverse=True)
        often = np.bincount(inverse, np.concatenate([c[3] for c in cells]), len(keys))[inverse] > 1
        a, k, answers = 0, 0, []
        for cell in cells:
            n, m = int(cell[0].sum()), len(cell[2])
            answers.append(pack(np.array([n, m]), np.packbits(found[a : a + n]), np.packbits(often[k : k + m])))
            a, k = a + n, k + m
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()), "cell": pa.array(answers, pa.binary())})

    return run


def _removed(length: int, gram: int, texts: bool):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = sorted(answers.to_pylist(), key=lambda x: x["shard"])
        first = unpack(rows[0]["cell"], *[np.uint8] * int(np.frombuffer(rows[0]["cell"], np.int64, 1)[0]))
        b = Judged(docs, length, gram, [x.tobytes() for x in first])
        second = [unpack(x["cell"], np.int64, np.uint8, np.uint8) for x in rows[1:]]
        found = np.concatenate([np.unpackbits(x[1], count=int(x[0][0])) for x in second]).astype(bool)
        often = np.concatenate([np.unpackbits(x[2], count=int(x[0][1])) for x in second]).astype(bool)
        s = b.stretches
        change = np.zeros(len(b.data) + 1, np.int32)

        def cover(at: np.ndarray, until: np.ndarray) -> None:
            np.add.at(change, at, 1)
            np.add.at(change, until, -1)

        every = np.flatnonzero(b.whole[b.which])
        cover(s.start[every], s.start[every] + s.count[every] + length - 1)
        at, _ = b.windows(b.sorted)
        cover(at[found], at[found] + length)
        keys, inverse = np.unique(b.window_hashes(), return_inverse=True)
        if len(keys) != len(often):
            raise RuntimeError("a block changed between two readings; write the documents to a table first")
        at = b.counted_at[often[inverse]] if len(keys) else np.zeros(0, np.int64)
        cover(at, at + length)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        edge = np.zeros(len(gone) + 1, bool)
        edge[b.offsets] = True
        begins = gone.copy()
        begins[1:] &= ~gone[:-1] | edge[1:-1]
        kept = b.data[~gone]
        lost = np.concatenate([[0], np.cumsum(gone)])[b.offsets]
        runs = np.concatenate([[0], np.cumsum(begins)])[b.offsets]
        at = b.offsets - lost
        spans = [memoryview(kept)[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        out = {
            "doc_id": b.table.column("doc_id"),
            "n_bytes": pa.array(np.diff(b.offsets)),
            "n_removed": pa.array(np.diff(lost)),
            "n_spans": pa.array(np.diff(runs)),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in spans], pa.string()),
        }
        if texts:
            out["kept"] = pa.array([x.tobytes() for x in spans], pa.binary())
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, most_stretches: int = MOST_STRETCHES, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with texts the bytes kept) of docs(doc_id, text)."""
    if not 8 <= gram <= length:
        raise ValueError("anchors need 8 bytes or more and fit the length")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = block_count(size, block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    cell = "shard int, block int, cell binary"
    first = rows.groupBy("block").applyInArrow(_first_cells(blocks, length, gram), cell)
    answers = first.groupBy("shard").applyInArrow(_first_answers(most_stretches), "block int, shard int, cell binary")
    second = materialise(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_second_cells(SHARDS_PER_BLOCK * blocks, length, gram), cell), "stretches")
    found = second.where("shard >= 0").groupBy("shard").applyInArrow(_second_answers(length), "block int, shard int, cell binary")
    given = found.unionByName(second.where("shard < 0"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_removed(length, gram, texts), out)
