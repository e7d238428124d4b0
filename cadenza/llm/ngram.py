"""Language-model scoring with an Elias-Fano n-gram trie.

The trie has three levels. The first holds the words in the order of their hash with their counts,
the second the successors of each word, the third the successors of each pair, the latter two
with quantised, discounted probabilities. Each node has a quantised back-off weight and a monotone
pointer to its successors. A level's names are kept relative to their context: to each name is added
the last value before the context's range, so that the whole level is one monotone sequence. Words,
pointers and levels are Elias-Fano sequences in a file that is mapped into memory. An n-gram is
found by a successor search from its context's base inside the range that two pointers bound.

The trie is dealt into shards by the hash of the first word, so no machine ever holds
the whole model and nothing is broadcast. Documents are dealt into blocks. Each block
sends each shard its distinct words, pairs and triples with their training counts (so a hot word or
pair travels once a block); the shard sums them, builds its part of the trie, answers
each block's list from it, and the block adds up its documents.

p(t | v) = max(c(v,t) - D, 0) / c(v) + D * n(v) / c(v) * (c(t) + 1) / (N + V + 1) and
p(t | u,v) = max(c(u,v,t) - D, 0) / c(u,v) + D * n(u,v) / c(u,v) * p(t | v), where n counts the distinct
successors of a context; an unseen context leaves the last factor alone. Each text follows one
beginning, so its first token has a context of one word.

Defined cases: null text counts as empty and has one token, its end; without training
rows every probability is 1 / (V + 1) = 1; equal rows score alike, also those without a key; very
long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._eliasfano import EliasFano
from ._store import block_count
from ._text import U64, as_bytes, chunks, mix, words

#: Bytes of text in a block, and of distinct n-grams that a shard is meant for.
BLOCK_BYTES = 12_000_000
DISCOUNT = 0.75
BEGIN, END = mix(np.array([0xB0, 0xE0], U64))
#: Bits of a successor's name after a word, and after a pair.
NAME_BITS, SHORT_BITS = 40, 32
#: Probabilities and weights are kept as two bytes of a logarithmic scale. It reaches down to 1e-20,
#: below (1 - DISCOUNT) / c for any count c of 64 bits.
STEP = 20.0 / 65534
LEVELS = np.concatenate([[0.0], 10.0 ** -(np.arange(65535) * STEP)])


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 stands for probability 0."""
    with np.errstate(divide="ignore"):
        code = 1 + np.clip(np.rint(-np.log10(p) / STEP), 0, 65534)
    return np.where(p > 0, code, 0).astype(np.uint16)


def pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    at = 8 + 8 * n
    out = []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def squeeze(blob: bytes) -> bytes:
    """A blob in fewer bytes: counts and codes are mostly alike, which the shuffle's own compression makes little of."""
    return len(blob).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(blob, asbytes=True)


def opened(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)


class Level:
    """Successors of contexts: pointers to their ranges, and names relative to the last value before them."""

    def __init__(self, pointers: EliasFano, names: EliasFano, chances: np.ndarray):
        self.pointers, self.names, self.chances = pointers, names, chances

    @staticmethod
    def arrays(context: np.ndarray, name: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
        """Pointers and relative names of (context, name) in their order."""
        kinds = np.bincount(context, minlength=contexts)
        pointers = np.concatenate([[0], np.cumsum(kinds)])
        last = np.zeros(contexts, U64)
        some = np.flatnonzero(kinds)
        last[some] = name[pointers[some + 1] - 1].astype(U64) + U64(1)
        if float(last.astype(np.float64).sum()) >= 2.0**63:
            raise OverflowError("a shard holds too many contexts; use more shards")
        before = np.concatenate([[0], np.cumsum(last)]).astype(U64)
        return pointers, before[context] + name.astype(U64) + U64(1)

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of contexts end, and the value that their names are relative to."""
        begin, end = self.pointers.access(context).astype(np.int64), self.pointers.access(context + 1).astype(np.int64)
        base = np.zeros(len(context), U64)
        some = np.flatnonzero(begin > 0)
        base[some] = self.names.access(begin[some] - 1)
        return np.where(end > begin, end, 0), base

    def find(self, end: np.ndarray, base: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Positions of names after contexts of these ranges, -1 where there is none."""
        if not self.names.n:
            return np.full(len(name), -1)
        want = base + name + U64(1)
        at = self.names.successor(want)
        safe = np.minimum(at, self.names.n - 1)
        return np.where((at < end) & (self.names.access(safe) == want), safe, -1)

    def codes(self, at: np.ndarray) -> np.ndarray:
        """Codes of the discounted probabilities at positions."""
        return np.where(at >= 0, self.chances[np.maximum(at, 0)] if len(self.chances) else 0, 0).astype(np.uint16)


class Trie:
    """One shard of the model, in memory-mapped levels."""

    def __init__(self, path: str):
        head = np.fromfile(path, np.int64, 32)
        self.words, self.pairs, self.triples, self.total, self.distinct = (int(x) for x in head[:5])
        held = np.memmap(path, np.uint8, "r")
        at, parts = 256, []
        for size, kind in zip(head[5:20].tolist(), [U64] * 11 + [np.uint16] * 4, strict=True):
            parts.append(held[at : at + size].view(kind))
            at += (size + 7) // 8 * 8
        width = head[20:25].tolist()
        self.names = EliasFano(self.words, width[0], parts[0], parts[1])
        self.second = Level(EliasFano(self.words + 1, width[1], parts[2], parts[3]), EliasFano(self.pairs, width[2], parts[4], parts[5]), parts[12])
        self.third = Level(EliasFano(self.pairs + 1, width[3], parts[6], parts[7]), EliasFano(self.triples, width[4], parts[8], parts[9]), parts[14])
        #: Counts of words; back-off weights of words and of pairs.
        self.counts, self.weights, self.pair_weights = parts[10], parts[11], parts[13]

    @staticmethod
    def write(path: str, names: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...], discount: float = DISCOUNT) -> None:
        """names: sorted hashes; counts: of words; pairs and triples: context (index into words, into pairs),
        name and times, in that order."""
        parts, chances, width = [], [], []
        for (context, name, times), contexts in ((pairs, len(names)), (triples, len(pairs[0]))):
            total, kinds = np.bincount(context, times, contexts), np.bincount(context, minlength=contexts)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            chances += [quantise(weight), quantise(np.maximum(times - discount, 0) / np.maximum(total[context], 1))]
            pointers, relative = Level.arrays(context, name, contexts)
            for values, universe in ((pointers, len(context) + 1), (relative, int(relative[-1]) + 1 if len(relative) else 1)):
                w, high, low = EliasFano.levels(values, universe)
                parts += [high, low]
                width.append(w)
        w, high, low = EliasFano.levels(names, 1 << 64)
        parts = [high, low, *parts, counts.astype(U64), *chances]
        head = [len(names), len(pairs[0]), len(triples[0]), int(counts.sum()), int((counts > 0).sum()), *(x.nbytes for x in parts), w, *width]
        with open(path, "wb") as f:
            f.write(np.array(head + [0] * (32 - len(head)), np.int64).tobytes())
            for x in parts:
                f.write(x.tobytes() + b"\0" * (-x.nbytes % 8))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words, and which of them the trie has."""
        if not self.words:
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = self.names.successor(hashes)
        safe = np.minimum(at, self.words - 1)
        return safe, (at < self.words) & (self.names.access(safe) == hashes)


class Block:
    """The n-grams of a block of documents, in an order that depends on the block's set of n-grams alone."""

    def __init__(self, table: pa.Table, train: np.ndarray):
        data, offsets = as_bytes(table.column("text"))
        tokens, sizes = [], []
        for i, j in chunks(offsets):
            h, at, _, _ = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            tokens.append(h)
            sizes.append(np.diff(at))
        h = np.concatenate(tokens) if tokens else np.zeros(0, U64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        n = len(size)
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        doc = np.repeat(np.arange(n), size + 1)
        ends = self.at[1:] - 1
        follower = np.empty(len(doc), U64)
        inner = np.ones(len(doc), bool)
        inner[ends] = False
        follower[inner], follower[ends] = h, END
        self.words, token = np.unique(np.concatenate([follower, [BEGIN]]), return_inverse=True)
        self.token = token[:-1]
        context = np.empty(len(doc), np.int64)
        context[1:] = self.token[:-1]
        context[self.at[:-1]] = token[-1]
        self.context = context
        self.pairs, self.pair = np.unique((context << 32) | self.token, return_inverse=True)
        weight = train[doc].astype(np.float64)
        self.word_times = np.bincount(self.token, weight, len(self.words)).astype(np.uint32)
        self.pair_times = np.bincount(self.pair, weight, len(self.pairs)).astype(np.uint32)
        #: Of each token but the first of a document the pair before it with the token, among the distinct triples.
        self.later = np.flatnonzero(self._later())
        self.triples, self.triple = np.unique((self.pair[self.later - 1] << 32) | self.token[self.later], return_inverse=True)
        self.triple_times = np.bincount(self.triple, weight[self.later], len(self.triples)).astype(np.uint32)

    def _later(self) -> np.ndarray:
        out = np.ones(len(self.token), bool)
        out[self.at[:-1]] = False
        return out

    def cells(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each shard's words, pairs and triples begin."""
        bounds = np.array([((s << 64) + shards - 1) // shards for s in range(shards)], object)
        at = np.searchsorted(self.words, bounds.astype(U64))
        at = np.append(at, len(self.words))
        pairs = np.searchsorted(self.pairs >> 32, at)
        return at, pairs, np.searchsorted(self.triples >> 32, pairs)


def _few(times: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, with the places and values of the large ones."""
    large = np.flatnonzero(times >= 255).astype(np.uint32)
    return [np.minimum(times, 255).astype(np.uint8), large, times[large]]


def _many(few: np.ndarray, large: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = few.astype(np.int64)
    out[large] = more
    return out


def _requests(shards: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block(table, table.column("train").to_numpy(zero_copy_only=False))
        at, pairs, triples = block.cells(shards)
        blobs = []
        name = block.words[block.pairs & 0xFFFFFFFF] >> U64(64 - NAME_BITS)
        five = name.view(np.uint8).reshape(-1, 8)[:, :5]
        short = (block.words[block.triples & 0xFFFFFFFF] >> U64(64 - SHORT_BITS)).astype(np.uint32)
        kinds = np.bincount(block.pairs >> 32, minlength=len(block.words)).astype(np.uint32)
        kinds_after = np.bincount(block.triples >> 32, minlength=len(block.pairs)).astype(np.uint32)
        for s in range(shards):
            w, p, t = slice(at[s], at[s + 1]), slice(pairs[s], pairs[s + 1]), slice(triples[s], triples[s + 1])
            blobs.append(squeeze(pack(block.words[w], block.word_times[w], kinds[w], np.ascontiguousarray(five[p]), *_few(block.pair_times[p]), kinds_after[p], short[t], *_few(block.triple_times[t]))))
        return pa.table({"shard": pa.array(np.arange(shards), pa.int32()), "block": pa.array([key[0].as_py()] * shards, pa.int32()), "cell": pa.array(blobs, pa.binary())})

    return run


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys that were counted, in order, and their counts."""
    some = times > 0
    key, times = key[some], times[some]
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)


def _split(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (key >> U64(bits)).astype(np.int64), key & U64((1 << bits) - 1)


def _answers(discount: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asked = []
        for blob in table.column("cell").to_pylist():
            name, times, kinds, five, few, large, more, kinds_after, short, few_after, large_after, more_after = unpack(
                opened(blob), U64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8, np.uint32, np.uint32
            )
            wide = np.zeros((len(few), 8), np.uint8)
            wide[:, :5] = five.reshape(-1, 5)
            asked.append((name, times, kinds, wide.view(U64).reshape(-1), _many(few, large, more), kinds_after, short, _many(few_after, large_after, more_after)))
        whole = lambda k: np.concatenate([x[k] for x in asked])
        names, word = np.unique(whole(0), return_inverse=True)
        counts = np.bincount(word, whole(1), len(names)).astype(np.int64)
        context = np.repeat(word, whole(2))
        key_of = (context.astype(U64) << U64(NAME_BITS)) | whole(3)
        pairs, pair_times = _summed(key_of, whole(4))
        # A triple was counted only where its pair was.
        context = np.repeat(np.searchsorted(pairs, key_of), whole(5))
        triples, triple_times = _summed((context.astype(U64) << U64(SHORT_BITS)) | whole(6).astype(U64), whole(7))
        del context, key_of
        replies = []
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "trie")
            Trie.write(path, names, counts, (*_split(pairs, NAME_BITS), pair_times), (*_split(triples, SHORT_BITS), triple_times), discount)
            del pairs, pair_times, triples, triple_times
            trie = Trie(path)
            for name, _, kinds, follower, _, kinds_after, short, _ in asked:
                at, _ = trie.find(name)
                where = _located(trie.second, at, kinds, follower)
                after = _located(trie.third, where, kinds_after, short)
                weights = np.where(where >= 0, trie.pair_weights[np.maximum(where, 0)] if trie.pairs else 1, 1).astype(np.uint16)
                replies.append(squeeze(pack(np.array([trie.total, trie.distinct], np.int64), trie.counts[at], trie.weights[at], trie.second.codes(where), weights, trie.third.codes(after))))
            del trie
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "answer": pa.array(replies, pa.binary())})

    return run


def _located(level: Level, context: np.ndarray, kinds: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Positions of kinds[i] names after each context, -1 where there is none."""
    known = np.flatnonzero(context >= 0)
    end, base = np.zeros(len(context), np.int64), np.zeros(len(context), U64)
    end[known], base[known] = level.ranges(context[known])
    end, base = np.repeat(end, kinds), np.repeat(base, kinds)
    out = np.empty(len(name), np.int64)
    for i in range(0, len(name), 1 << 18):
        part = slice(i, i + (1 << 18))
        out[part] = level.find(end[part], base[part], name[part].astype(U64))
    return out


def _scores(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
    block = Block(docs, np.zeros(len(docs), bool))
    parts = [unpack(opened(x["answer"]), np.int64, U64, *[np.uint16] * 4) for x in sorted(answers.to_pylist(), key=lambda x: x["shard"])]
    total, distinct = sum(int(x[0][0]) for x in parts), sum(int(x[0][1]) for x in parts)
    count, weight, chance, pair_weight, triple_chance = (np.concatenate([x[k] for x in parts]) for k in range(1, 6))
    if len(count) != len(block.words) or len(chance) != len(block.pairs) or len(triple_chance) != len(block.triples):
        raise RuntimeError("a block changed between two readings; write the documents to a table first")
    base = (count + 1.0) / (total + distinct + 1.0)
    mine = base[block.token]
    p = LEVELS[chance[block.pair]] + LEVELS[weight[block.context]] * mine
    p[block.later] = LEVELS[triple_chance[block.triple]] + LEVELS[pair_weight[block.pair[block.later - 1]]] * p[block.later]
    begin = block.at[:-1]
    n = len(docs)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(np.diff(block.at)),
            "n_known": pa.array(np.add.reduceat((count[block.token] > 0).astype(np.int64), begin)),
            "train_tokens": pa.array(np.full(n, total, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(mine), begin)),
            "score": pa.array(np.add.reduceat(np.log10(np.minimum(p, 1.0)), begin)),
        }
    )


def score(docs: DataFrame, held_out, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores every row of docs(doc_id, text) under a model of those that are not held out.

    held_out: a boolean Column. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (log10 probability by the trie)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = block_count(size, block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    rows = rows.withColumn("train", ~F.col("held_out")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    cells = rows.groupBy("block").applyInArrow(_requests(blocks), "shard int, block int, cell binary")
    answers = cells.groupBy("shard").applyInArrow(_answers(discount), "block int, shard int, answer binary")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores, out)
