"""Near duplicates by SetSketch registers.

A document's set holds its distinct word shingles. A sketch keeps, for each of M hash
functions, the exponentially spaced, truncated minimum over the set: register
floor(1 - log_b x) of the least exponential variate x. Registers merge by maximum and
agree with a probability close to the Jaccard similarity.

1. Equal sets become one class (pre-aggregated by a 128-bit fingerprint).
2. Bands of ROWS registers are hashed; each bucket links its members to its least
   class by a sum over the bucket, so a bucket of any size gives one row a member.
3. Pairs are estimated jointly: given both cardinalities, the similarity that makes
   the counts of larger, smaller and equal registers likeliest. Pairs far below the
   threshold go.
4. What remains is verified on the full sets; verified links make components. First
   one link of each class is verified, then those that still join two components.
5. Buckets that still hold several components are searched for pairs across them:
   members outside a bucket's largest component against all members, in tiles of
   bounded size, by longer sketches of which each register keeps its low byte. Only
   pairs whose estimate nears the threshold leave a tile, to be verified.

BANDS x ROWS miss a pair of exactly the threshold in all bands with probability
(1 - 0.8**4)**28 < 1e-6; the estimates' margins are 5 and 4.5 standard deviations.

Defined cases: null or empty text and text without words have an empty set and are
linked with nothing; equal texts are linked; repeated rows of one key come back each; a
row without a key has no smallest key to name, so it is linked with nothing and comes
back with the size of its set, a null component_id and kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, materialise
from ._text import U64, as_bytes, chunks, group_index, mix, pair_hash, words

ROWS, BANDS = 4, 28
REGISTERS = ROWS * BANDS
#: Register base and rate of the sketch; registers fit 16 bits for sets of 1 to 10**12.
BASE, RATE, LIMIT = 1.002, 20.0, 65534
#: Registers of the longer sketches, and rows of a tile's side.
LONG, TILE = 1024, 1024
#: Rows of (key, role) that are broadcast at most; beyond, the text is joined by shuffle.
MOST_BROADCAST = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and n + 1 offsets."""
    h, at, _, _ = words(data, offsets)
    n = len(offsets) - 1
    count = np.diff(at)
    own = group_index(at)
    out = h
    for k in range(1, size):
        nxt = np.zeros_like(h)
        nxt[: len(h) - k] = h[k:] if k < len(h) else h[:0]
        place = np.arange(len(h)) - at[own]
        out = np.where(place + k < count[own], pair_hash(out, nxt), out)
    place = np.arange(len(h)) - at[own]
    # A start whose shingle would pass the end counts only where the whole document is shorter.
    keep = (place + size <= count[own]) | ((count[own] < size) & (place == 0))
    out, own = out[keep], own[keep]
    order = np.lexsort((out, own))
    out, own = out[order], own[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    out, own = out[fresh], own[fresh]
    return out, np.searchsorted(own, np.arange(n + 1)).astype(np.int64)


def sketches(sets: np.ndarray, at: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers, documents x registers; documents must not be empty."""
    x = (mix(sets) >> U64(32)).astype(np.uint32)
    least = np.empty((registers, len(at) - 1), np.uint32)
    factor = (mix(np.arange(registers) + 77) >> U64(32)).astype(np.uint32) | np.uint32(1)
    flip = (mix(np.arange(registers) + 100_077) >> U64(32)).astype(np.uint32)
    for j in range(registers):
        least[j] = np.minimum.reduceat((x ^ flip[j]) * factor[j], at[:-1])
    u = (least.T.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)) + 8000, 0, LIMIT).astype(np.uint16)


def likeliest(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood, given registers and cardinalities."""
    more = (left > right).sum(1).astype(float)
    less = (left < right).sum(1).astype(float)
    same = left.shape[1] - more - less
    total = n_left + n_right
    u, v = n_left / total, n_right / total
    scale = np.log(BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / scale

    def value(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        better = value(a) < value(b)
        low, high = np.where(better, a, low), np.where(better, high, b)
    return (low + high) / 2


def _sketch_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in chunks(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                registers: list[bytes | None] = [None] * (j - i)
                one, two = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                if len(some):
                    for k, r in zip(some.tolist(), sketches(sets, np.append(at[some], len(sets))), strict=True):
                        registers[k] = r.tobytes()
                    one[some] = np.add.reduceat(mix(sets), at[some]).view(np.int64)
                    two[some] = np.add.reduceat(mix(sets ^ U64(0x5851F42D4C957F2D)), at[some]).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(n), pa.array(one), pa.array(two), pa.array(registers, pa.binary())], ["doc_id", "n", "h1", "h2", "registers"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        data, _ = as_bytes(batch.column("registers"))
        r = data.view(np.uint16).reshape(n, BANDS, ROWS).astype(U64)
        key = np.full((n, BANDS), U64(1), U64) * np.arange(1, BANDS + 1).astype(U64)
        for k in range(ROWS):
            key = pair_hash(key, r[:, :, k])
        band = np.tile(np.arange(BANDS, dtype=np.int32), n)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), batch.column("doc_id").take(pa.array(np.repeat(np.arange(n), BANDS)))], ["bucket", "band", "doc_id"])


def _estimate(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (as_bytes(batch.column(c))[0].view(np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            guess = likeliest(left, right, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float))
            keep = guess >= least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(guess[keep])], ["a", "b", "guess"])

    return run


def _long_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                long = sketches(sets, at, LONG)
                low, first = (long & 255).astype(np.uint8), np.ascontiguousarray(long[:, :REGISTERS])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x.tobytes() for x in first], pa.binary())], ["doc_id", "low", "registers"])

    return run


def _tile(least: float):
    def run(table: pa.Table) -> pa.Table:
        ids, comp, asks = (table.column(c).to_numpy() for c in ("doc_id", "comp", "asks"))
        low = as_bytes(table.column("low"))[0].reshape(-1, LONG)
        registers = as_bytes(table.column("registers"))[0].view(np.uint16).reshape(-1, BANDS, ROWS)
        band = table.column("band")[0].as_py()
        q, t = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = [np.zeros((0, 2), np.int64)]
        wide = np.ascontiguousarray(low[t])
        for i in q.tolist():
            same = (wide == low[i]).sum(1) / LONG
            near = (same - 1 / 256) / (1 - 1 / 256) >= least
            hit = t[near & (comp[t] != comp[i])]
            # A pair leaves the first of the buckets that it shares.
            hit = hit[(registers[hit] == registers[i]).all(2).argmax(1) == band]
            found.append(np.stack([np.maximum(ids[hit], ids[i]), np.minimum(ids[hit], ids[i])], 1))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    return run


def _across(docs: DataFrame, members: DataFrame, comp: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and look similar enough."""
    rows = members.join(comp, "doc_id").select("bucket", "band", "doc_id", "comp")
    parts = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    parts = parts.groupBy("bucket").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("main")).where("comps > 1")
    rows = rows.join(parts.select("bucket", "size", F.col("main.comp").alias("main"), (F.col("size") - F.col("main.n")).alias("few")), "bucket")
    rows = materialise(rows, "open")
    who = rows.select("doc_id").distinct()
    texts = docs.join(F.broadcast(who) if who.count() <= MOST_BROADCAST else who, "doc_id")
    low = texts.dropDuplicates(["doc_id"]).mapInArrow(_long_rows(size), "doc_id long, low binary, registers binary")
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), tiles(n)).cast("int")
    target = rows.select("bucket", "band", "doc_id", "comp", F.lit(False).alias("asks"), deal("size").alias("t"), F.explode(F.sequence(F.lit(0), tiles("few") - 1)).alias("q"))
    query = rows.where("comp != main").select("bucket", "band", "doc_id", "comp", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), tiles("size") - 1)).alias("t"), deal("few").alias("q"))
    margin = 4.5 * np.sqrt(percent / 100 * (1 - percent / 100) / LONG)
    return target.unionByName(query).join(low, "doc_id").groupBy("bucket", "t", "q").applyInArrow(_tile(percent / 100 - margin), "a long, b long").distinct()


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                packed = [sets[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("targets")[i:j], batch.column("second")[i:j], pa.array(packed, pa.binary())], ["doc_id", "targets", "second", "items"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sets are made anew from the texts of
    the documents concerned and travel once, to the pair's second document."""
    roles = pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("target")).unionAll(pairs.select(F.col("b").alias("doc_id"), F.lit(None).cast("long").alias("target")))
    roles = materialise(roles.groupBy("doc_id").agg(F.collect_set("target").alias("targets"), F.bool_or(F.col("target").isNull()).alias("second")), "roles")
    texts = docs.join(F.broadcast(roles) if roles.count() <= MOST_BROADCAST else roles, "doc_id")
    sets = texts.select("doc_id", "targets", "second", "text").mapInArrow(_set_rows(size), "doc_id long, targets array<long>, second boolean, items binary")
    left = sets.select(F.explode("targets").alias("b"), F.col("doc_id").alias("a"), F.col("items").alias("xa"))
    right = sets.where("second").select(F.col("doc_id").alias("b"), F.col("items").alias("xb"))
    return left.join(right, "b").select("a", "b", "xa", "xb").mapInArrow(_verify(percent), "a long, b long")


def connect(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, comp): the least doc_id reachable over links(a, b), for nodes(doc_id).

    Least labels travel over links and are then shortened by following the label's own
    label, so the rounds grow with the logarithm of a component's width. Each round is
    a written table."""
    ends = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    labels = materialise(ends.select(F.col("a").alias("doc_id")).distinct().withColumn("comp", F.col("doc_id")), "labels")
    while True:
        there = labels.select(F.col("doc_id").alias("b"), F.col("comp").alias("theirs"))
        least = ends.join(there, "b").groupBy("a").agg(F.min("theirs").alias("theirs")).withColumnRenamed("a", "doc_id")
        step = labels.join(least, "doc_id", "left").select("doc_id", F.col("comp").alias("old"), F.least("comp", "theirs").alias("comp"))
        step = materialise(step, "labels")
        far = step.select(F.col("doc_id").alias("comp"), F.col("comp").alias("further"))
        labels = materialise(step.join(far, "comp").select("doc_id", "old", F.col("further").alias("comp")), "labels")
        moved = labels.where("old != comp").limit(1).count()
        labels = labels.select("doc_id", "comp")
        if not moved:
            break
    return nodes.join(labels, "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("comp"))


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs(doc_id, text).

    Documents are linked where 100 * intersection >= percent * union; component_id is the
    least doc_id reachable. One row per input row."""
    bound_batches(docs.sparkSession)
    if not 60 <= percent <= 100:
        raise ValueError("bands are laid out for similarities of 0.6 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = materialise(docs.mapInArrow(_sketch_rows(size), "doc_id long, n long, h1 long, h2 long, registers binary"), "sketches")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    some = all_rows.where(linkable)
    classes = materialise(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    leads = materialise(some.join(classes.select(F.col("class_id").alias("doc_id"), "h1", "h2", "n"), ["doc_id", "h1", "h2", "n"], "left_semi").select("doc_id", "n", "registers").dropDuplicates(["doc_id"]), "leads")
    # Every bucket with two classes or more. Its head is the class that meets the most
    # others over all its buckets: of a text and its varied copies, mostly the text.
    rows = leads.mapInArrow(_bands, "bucket long, band int, doc_id long")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(rows.join(shared, "bucket"), "members")
    known = members.groupBy("doc_id").agg(F.sum("size").alias("met"))
    heads = members.join(known, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct("met", -F.col("doc_id"))).alias("head"))
    pairs = members.join(heads, "bucket").where("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    slim = leads.select("doc_id", "n")
    regs = leads.select("doc_id", "n", "registers")
    margin = 5 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def likely(pairs: DataFrame) -> DataFrame:
        fit = pairs.join(slim.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(slim.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
        fit = fit.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        fit = fit.join(regs.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra")), "a").join(regs.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb")), "b")
        return fit.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimate(percent / 100 - margin), "a long, b long, guess double")

    candidates = materialise(likely(pairs), "candidates")
    ids = leads.select("doc_id")
    # First the likeliest link of each class, then what still joins two components.
    best = candidates.groupBy("a").agg(F.max_by("b", F.struct("guess", "b")).alias("b"))
    links = materialise(_verified(docs, materialise(best.select("a", "b"), "best"), size, percent), "links")
    comp = materialise(connect(ids, links), "comp")

    def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        ca, cb = comp.select(F.col("doc_id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("doc_id").alias("b"), F.col("comp").alias("cb"))
        return pairs.join(ca, "a").join(cb, "b").where("ca != cb").select("a", "b")

    tried = best.select("a", "b")
    left = materialise(across(candidates.join(tried, ["a", "b"], "left_anti").select("a", "b"), comp), "left")
    if left.limit(1).count():
        links = links.unionAll(materialise(_verified(docs, left, size, percent), "links"))
        comp = materialise(connect(ids, links), "comp")
    # Buckets whose members are still in several components.
    rest = materialise(_across(docs, members, comp, size, percent), "rest")
    if rest.limit(1).count():
        links = links.unionAll(materialise(_verified(docs, rest, size, percent), "links"))
        comp = materialise(connect(ids, links), "comp")
    found = classes.join(comp.withColumnRenamed("doc_id", "class_id"), "class_id").select("h1", "h2", "n", "comp")
    # Rows without words all have one fingerprint; they are not joined.
    out = some.join(found, ["h1", "h2", "n"]).select("doc_id", "n", "comp").unionAll(all_rows.where(~linkable).select("doc_id", "n", F.col("doc_id").alias("comp")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def components_sql(size: int = 2, percent: int = 80, table: str = "documents") -> str:
    """DuckDB SQL for the same rows by comparing all pairs that share a shingle; for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
sets AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: {run})) END) AS s FROM t),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM {table} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)"""
