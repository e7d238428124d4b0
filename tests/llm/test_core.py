from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import _text
from cadenza.llm._eliasfano import EliasFano
from cadenza.llm._store import block_count
from cadenza.llm.fingerprint import _of, likeness
from cadenza.llm.leaks import common_subsequence
from cadenza.llm.neardup import likeliest, shingle_sets, sketches
from cadenza.llm.ngram import LEVELS, Trie, _located
from cadenza.llm.sharding import fill
from cadenza.llm.substring import repeated_windows
from cadenza.llm.suffix import common_prefixes, suffix_array

LETTERS = st.text(alphabet="ab \t\n\x0bÄ", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, max_size=6))
def test_words_are_split_as_bytes(texts):
    data, offsets = _text.as_bytes(pa.array(texts, pa.string()))
    hashes, at, start, end = _text.words(data, offsets)
    raw = data.tobytes()
    got = [[raw[s:e] for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [t.encode().split() for t in texts]
    names: dict[bytes, int] = {}
    for h, s, e in zip(hashes.tolist(), start, end, strict=True):
        assert names.setdefault(raw[s:e], h) == h
    assert len(set(names.values())) == len(names)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60) | st.text(alphabet="ab", max_size=80).map(str.encode))
def test_suffix_array(raw):
    data = np.frombuffer(raw, np.uint8)
    order = suffix_array(data)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    if len(raw) > 1:
        for k, got in enumerate(common_prefixes(data, order, 9).tolist()):
            a, b = raw[order[k] :], raw[order[k + 1] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert got == min(n, 9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=5, max_size=20).map(str.encode), min_size=1, max_size=6))
def test_repeated_windows(strings):
    n = 5
    counts = np.array([len(s) - n + 1 for s in strings])
    windows = [s[i : i + n] for s in strings for i in range(len(s) - n + 1)]
    got = repeated_windows(counts, np.frombuffer(b"".join(strings), np.uint8), n)
    assert got.tolist() == [windows.count(w) > 1 for w in windows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=80), st.lists(st.integers(0, 2**40), max_size=30))
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, np.uint64))
    e = EliasFano.of(v, 2**40 + 1)
    assert e.access(np.arange(len(v))).tolist() == v.tolist()
    assert e.successor(np.array(asked, np.uint64)).tolist() == np.searchsorted(v, np.array(asked, np.uint64)).tolist()


def trie_of(path, names, counts, context, name, times):
    """A trie of words and pairs, without triples."""
    none = np.zeros(0, np.int64)
    Trie.write(str(path / "t"), np.array(names, np.uint64), np.array(counts), (np.array(context), np.array(name, np.uint64), np.array(times)), (none, none.view(np.uint64), none), 0.75)
    return Trie(str(path / "t"))


def codes(trie, context, name):
    return trie.second.codes(_located(trie.second, np.array(context), np.ones(len(context), np.int64), np.array(name, np.uint64)))


def test_trie_answers_from_its_file(tmp_path):
    trie = trie_of(tmp_path, [5, 70, 900], [3, 0, 2], [0, 0, 2], [7, 9, 7], [2, 1, 2])
    assert (trie.total, trie.distinct) == (5, 2)
    at, found = trie.find(np.array([70, 71, 900], np.uint64))
    assert found.tolist() == [True, False, True] and at[2] == 2
    assert (codes(trie, [0, 0, 1, 2, -1], [7, 8, 7, 7, 7]) > 0).tolist() == [True, False, False, True, False]


def test_trie_keeps_large_counts(tmp_path):
    counts = np.array([2**32 + 5, 0, 2**40])
    trie = trie_of(tmp_path, [5, 70, 900], counts, [0], [7], [2**32 + 5])
    assert trie.counts.tolist() == counts.tolist() and (trie.total, trie.distinct) == (counts.sum(), 2)


@pytest.mark.parametrize("many", [10, 4 * 10**8, 10**13])
def test_trie_chances_after_frequent_contexts(tmp_path, many):
    times = np.array([many, 1, 2])
    trie = trie_of(tmp_path, [5, 70], [many + 3, 0], np.zeros(3, np.int64), [7, 8, 9], times)
    got = LEVELS[codes(trie, [0, 0, 0], [7, 8, 9])]
    assert got == pytest.approx((times - 0.75) / times.sum(), rel=5e-4, abs=0)
    assert LEVELS[trie.weights[0]] == pytest.approx(0.75 * 3 / times.sum(), rel=5e-4, abs=0)
    assert got.sum() + LEVELS[trie.weights[0]] == pytest.approx(1, abs=5e-4)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.8, 0.95):
        n = 2000
        both = int(n * 2 * j / (1 + j))
        pool = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
        s = sketches(np.concatenate([a, b]), np.array([0, n, n + len(b)]), 1024)
        guess = likeliest(s[:1], s[1:], np.array([float(n)]), np.array([float(len(b))]))[0]
        assert guess == pytest.approx(j, abs=0.06)


@pytest.mark.parametrize(("text", "size", "n"), [("", 2, 0), (" \n", 2, 0), ("one", 2, 1), ("a b a b", 2, 2), ("a b c d", 5, 1), ("a b c d e f", 5, 2)])
def test_shingle_sets(text, size, n):
    _, at = shingle_sets(*_text.as_bytes(pa.array([text])), size)
    assert at[-1] == n


def test_fingerprints_don_t_depend_on_place():
    words = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    a, b, c = _of([words, "some other beginning " + words, " ".join(f"v{i * 31 % 997}" for i in range(400))])
    assert likeness(a[None], b[None])[0] > 0.85 and likeness(a[None], c[None])[0] < 0.2
    assert (_of(["x", words])[1] == a).all()
    assert likeness(*(_of([t]) for t in ("", "")))[0] == 1 and likeness(*(_of([t]) for t in ("", "a")))[0] == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert common_subsequence(a, b) == best[-1][-1]


def test_cells_stay_in_proportion():
    assert block_count(0, 6_000_000) == 1 and block_count(800_000_000, 6_000_000) == 134
    for size in (10**9, 10**12, 10**14):
        n = block_count(size, 6_000_000)
        assert n * n <= size / 1000


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(13)]
    table = fill(names, 4099)
    counts = np.bincount(table, minlength=13)
    assert counts.max() - counts.min() <= 1
    fewer = fill(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 12)
    assert moved < 0.1 * 4099
    for bad in ((["a", "a"], 7), (["a"], 8), ([], 7)):
        with pytest.raises(ValueError, match="shards|prime"):
            fill(*bad)


def test_the_test_matrix_takes_little_more_than_itself():
    import tracemalloc

    from cadenza.llm import leaks

    tracemalloc.start()
    made = leaks.gaussian(4001, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * made.nbytes
    # Blocks change no number.
    x = (leaks.mix(np.arange(4001 * 256 * 2) + 11) >> leaks.U64(11)).astype(np.float64) / 2.0**53
    assert (made == (np.sqrt(-2 * np.log(x[::2] + 1e-300)) * np.cos(2 * np.pi * x[1::2])).reshape(4001, 256)).all()
