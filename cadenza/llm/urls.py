"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule is a host and a path prefix (`org/`, `example.org/es/`); it fits the host and its
subdomains where the path begins with the prefix, and the longest rule decides. Other
URLs are judged by trees boosted on the logistic loss over lexical features: lengths,
depth, digit ratios, entropies, parameter counts, hyphens, labels, vowels, runs without one, and
smoothed block rates of the host's suffix, of the file suffix, of the words and runs of GRAM
letters in the host, of the words of the path and of parameter names, as counted in the labelled URLs.

The trees are fitted on the driver on at most MOST_ROWS labelled URLs, a hash sample if there
are more (`fit`). `seed_urls` gives labelled URLs by rule where there are no others.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and
is judged by the trees on zero lengths; a null key is returned as it is; repeated rows are judged
alike; an empty path fits no rule; an empty table gives no rows; labelled rows without url or label
are left out, and without any the trees say nothing is blocked; extra columns named like the outputs
are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MOST_ROWS = 50_000
MOST_RULES = 1000
ROUNDS, DEPTH, RATE, BINS, GRAM = 60, 3, 0.2, 32, 4

# Word lists of the built-in URLs.
_LURES = "secure login signin verify account update billing support wallet bank password confirm recovery unlock alert".split()
_VICES = "casino poker bet slots jackpot lottery roulette adult xxx porn sex nude cams escort hookup fetish".split()
_SPAM = "pills viagra cialis replica payday crypto forex warez crack keygen torrent hack prize giveaway bonus miracle detox".split()
_PLAIN = (
    "news blog wiki docs book library school city garden music travel science history review journal weather recipe forum home health sport art photo code data "
    "research museum press times post daily letter note river mountain bridge window alphabet market street paper north south green stone light water field family"
).split()
_TRADES = "cheap free win best top buy deal credit loan bonus game play card click".split()
_CHEAP_ENDS = "tk ml ga cf gq top xyz click loan win bid ru cn cc pw icu buzz bet".split()
_ENDS = "com com com com net org org info io edu gov co.uk ac.uk de de fr fr es es it nl ch ca eu".split()
_TRACKERS = "aff clickid sub1 sub2 cid sid token session redirect u p uid hash pid utm".split()
# The commonest pairs of letters in English, and syllables.
_PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur".split()
_SYLLABLES = "an ber chan del dra for gra hol jo kin lin mor ne ol per qui ra sol ti un ver wo ya zen sten brook th er land ton wick ford mar el so ble ing sh".split()
_COMMON = "id page ref lang sort color size source utm_source utm_medium q t tag year sid session".split()
_TOPICS = "how to best way of the a guide learn new first why what for in on with making report story plan year people world house open local".split()


def _name(pick: random.Random) -> str:
    return "".join(pick.choice(_SYLLABLES if pick.random() < 0.6 else _PAIRS) for _ in range(pick.randint(2, 5)))


def _noise(pick: random.Random, n: int, letters: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> str:
    return "".join(pick.choice(letters) for _ in range(n))


def _query(pick: random.Random, names: list[str], n: int) -> str:
    return "?" + "&".join(f"{x}={_noise(pick, pick.randint(1, 16))}" for x in pick.sample(names, n)) if n else ""


def _bad(pick: random.Random) -> str:
    swap = lambda word: "".join({"l": "1", "o": "0", "e": "3", "i": "1", "a": "4", "s": "5"}.get(c, c) if pick.random() < 0.5 else c for c in word)
    name, kind = _name(pick), pick.randint(0, 4)
    end = pick.choice(_CHEAP_ENDS if pick.random() < 0.6 else _ENDS)
    if kind == 0:  # a look-alike that asks for a password
        parts = [swap(name), *pick.sample(_LURES, pick.randint(1, 3))]
        pick.shuffle(parts)
        host = pick.choice(["-", "-", "."]).join(parts) + "." + end
        path = "/" + "/".join(pick.sample(_LURES, pick.randint(0, 2))) + pick.choice(["", ".php", ".html", "/"])
        return f"{host}{path}{_query(pick, _TRACKERS, pick.randint(0, 3))}"
    if kind == 1:  # a bare address
        host = ".".join(str(pick.randint(1, 254)) for _ in range(4)) + pick.choice(["", "", f":{pick.randint(1000, 9999)}"])
        return f"{host}/{pick.choice([_noise(pick, 8), *_LURES])}{pick.choice(['.php', '.exe', '', '.zip', '/'])}{_query(pick, _TRACKERS, pick.randint(0, 3))}"
    if kind == 2:  # gambling and the like
        word = pick.choice(_VICES)
        host = pick.choice([f"{pick.randint(1, 99)}{pick.choice('xk')}{word}{pick.choice(['', str(pick.randint(1, 99))])}", f"{word}{pick.choice(['365', '88', '777', '24', 'hub', 'live', 'vip'])}", f"{pick.choice(_TRADES)}-{word}", f"{word}-{name}", f"{name}{word}", f"x{word}{name[:4]}", f"{word}.{name}"])
        return f"{host}.{end}/{pick.choice(['', 'promo', 'bonus', 'vip', 'join', f'{word}/{name}'])}{_query(pick, _TRACKERS, pick.randint(0, 2))}"
    if kind == 3:  # letters by chance, many parameters
        host = f"{_noise(pick, pick.randint(8, 20))}.{end}"
        return f"{host}/{_noise(pick, pick.randint(6, 24))}{_query(pick, _TRACKERS, pick.randint(1, 6))}"
    words = pick.sample(_SPAM, 2) + pick.sample(_TRADES, pick.randint(0, 2)) + pick.choice([["online"], ["now", "24"], [str(pick.randint(1, 999))], []])
    pick.shuffle(words)
    return f"{'-'.join(words)}.{end}/{pick.choice(['', '-'.join(words), 'order.php'])}{_query(pick, _TRACKERS, pick.randint(0, 3))}"


def _good(pick: random.Random) -> str:
    name, kind = _name(pick), pick.randint(0, 5)
    slug = "-".join(pick.choice(_TOPICS + _PLAIN) for _ in range(pick.randint(2, 7)))
    end = pick.choice(_ENDS)
    tail = pick.choice(["", "", "", *(f"?{_query(pick, _COMMON, pick.randint(1, 2))[1:]}" for _ in range(2)), "#" + pick.choice(_TOPICS)])
    number = pick.choice([str(pick.randint(1, 99999)), f"{pick.randint(1, 9999)}.{pick.randint(1, 99999)}", "s" + _noise(pick, 4, "0123456789") + "-" + _noise(pick, 3, "0123456789"), _noise(pick, 10, "ABCDEFGHIJ0123456789")])
    own = pick.choice([name, name, f"{name}{pick.choice(_PLAIN)}", f"{pick.choice(_PLAIN)}{name}", f"{pick.choice(_PLAIN)}-{name}", pick.choice(_PLAIN) + pick.choice(_PLAIN), f"{pick.choice(_TRADES)}-{pick.choice(_PLAIN)}", f"{pick.choice(_TRADES)}{pick.choice(_PLAIN)}s"])
    host = pick.choice(["", "", "www.", "m.", f"{pick.choice(_PLAIN)}."]) + own + "." + end
    if kind == 0:
        return f"{host}/{pick.randint(1998, 2030)}/{pick.randint(1, 12):02d}/{slug}{pick.choice(['', '/', '.html'])}{tail}"
    if kind == 1:
        return f"{host}/{pick.choice(_PLAIN)}/{pick.choice(_PLAIN)}/{pick.choice([name, number, slug])}{pick.choice(['', '.html', '.htm', '.pdf', '/'])}{tail}"
    if kind == 2:
        return f"{host}/{pick.choice(['product', 'item', 'shop', 'p'])}/{pick.choice([slug, number])}{tail}"
    if kind == 3:
        return f"{host}/{pick.choice(['viewtopic.php', 'thread.php', 'index.php'])}?{pick.choice(['t', 'id', 'topic'])}={pick.randint(1, 99999)}" if pick.random() < 0.4 else f"{host}/questions/{pick.randint(1, 99999)}/{slug}"
    if kind == 4:
        return f"{host}/{pick.choice(['', '', 'about', 'contact', 'account', 'support', 'login', 'index.html', 'wiki/' + name.title(), 'search?q=' + name])}"
    return f"{host}/{'/'.join(pick.choice([name, pick.choice(_PLAIN), pick.choice(_TOPICS)]) for _ in range(pick.randint(0, 3)))}/{number}{pick.choice(['', '/', '.html'])}{tail}"


def seed_urls(n: int = 12_000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled URLs (1: block) made by rule: look-alikes, bare addresses, vices, chance letters and spam
    against the usual addresses of news, institutions, shops, forums and homes."""
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        block = pick.random() < 0.5
        url = (_bad if block else _good)(pick)
        out.append((f"{pick.choice(['http', 'https'])}://{url}", int(block)))
    return out


_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)
_WORDS = re.compile(r"[a-z]+")


def split_url(url: str | None) -> tuple[str, str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(list(text), return_counts=True)[1] / len(text)
    return float(-(counts * np.log2(counts)).sum())


def _suffixes(host: str, path: str) -> tuple[str, str]:
    end = path.rsplit("/", 1)[-1]
    return "host:" + host.rsplit(".", 1)[-1], "file:" + (end.rsplit(".", 1)[-1] if "." in end else "")


def _parts(host: str, path: str = "", query: str = "") -> list[str]:
    words = _WORDS.findall(host.rpartition(".")[0] or host)
    parts = [f"word:{w}" for w in words] + [f"gram:{w[i : i + GRAM]}" for w in words for i in range(len(w) - GRAM + 1)]
    return parts + [f"path:{w}" for w in _WORDS.findall(path.lower())] + [f"name:{x.partition('=')[0].lower()}" for x in query.split("&") if x]


_ADDRESS = re.compile(r"[0-9.]+(:[0-9]+)?")
_MIXED = re.compile(r"[a-z][0-9]|[0-9][a-z]")
_HARD = re.compile("[bcdfghjklmnpqrstvwxz0-9]+")


class UrlModel:
    """Boosted trees and the suffix and word statistics that feed them."""

    def __init__(self, rows: list[tuple[str, int]]):
        rows = sorted(rows, key=lambda r: (r[0] or "", r[1]))
        y = np.array([r[1] for r in rows], float)
        self.base = float(y.mean()) if len(rows) else 0.0
        seen: dict[str, list[float]] = {}
        # Rates come from one half of the rows and trees from the other, so that no row's own label is among its features.
        half = [xxhash.xxh32_intdigest(r[0] or "") & 1 for r in rows]
        for url, label in (r for r, h in zip(rows, half, strict=True) if h):
            host, path, query = split_url(url)
            for k in {*_suffixes(host, path), *_parts(host, path, query)}:
                x = seen.setdefault(k, [0.0, 0.0])
                x[0] += label
                x[1] += 1
        self.rates = {k: (a + 6 * self.base) / (n + 6) for k, (a, n) in seen.items() if n >= 3}
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.edges: list[np.ndarray] = []
        self.start = float(np.log((self.base + 1e-3) / (1 - self.base + 1e-3)))
        if 0 < self.base < 1 and not all(half):
            other = ~np.array(half, bool)
            self._fit(np.array([self.features(r[0]) for r, h in zip(rows, half, strict=True) if not h]).reshape(int(other.sum()), -1), y[other])

    def features(self, url: str | None) -> list[float]:
        host, path, query = split_url(url)
        whole, letters = url or "", sum(c.isalpha() for c in host)
        known = _parts(host, path, query)
        words, grams, names, keys = ([self.rates.get(k, self.base) for k in known if k.startswith(kind)] for kind in ("word", "gram", "path", "name"))
        own = host.rpartition(".")[0] or host
        a, b = _suffixes(host, path)
        return [
            len(whole), len(host), len(path), path.count("/"), sum(c.isdigit() for c in whole) / max(1, len(whole)), _entropy(whole), _entropy(host),
            len([x for x in query.split("&") if x]), len(query), host.count("-"), sum(c.isdigit() for c in host), host.count(".") + 1,
            max((len(x) for x in host.split(".")), default=0), sum(c in "aeiou" for c in host) / max(1, letters),
            self.rates.get(a, self.base), self.rates.get(b, self.base), max(words, default=self.base), sum(words) / max(1, len(words)),
            max(grams, default=self.base), min(grams, default=self.base), sum(grams) / max(1, len(grams)),
            max(names, default=self.base), min(names, default=self.base), max(keys, default=self.base), float(bool(_ADDRESS.fullmatch(host))),
            len(_MIXED.findall(own)), max((len(x) for x in _HARD.findall(own)), default=0), sum(c.isdigit() for c in path) / max(1, len(path)),
        ]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], 1)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
        b = self._bins(x)
        f = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            column, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
            for level in range(DEPTH):
                for at in range(2**level - 1, 2 ** (level + 1) - 1):
                    mine = np.flatnonzero(node == at)
                    best = 1e-6
                    for i in range(x.shape[1]) if len(mine) > 20 else ():
                        g, h = np.bincount(b[mine, i], grad[mine], BINS + 1).cumsum(), np.bincount(b[mine, i], hess[mine], BINS + 1).cumsum()
                        gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, column[at], cut[at] = float(gain[k]), i, k
                    node[mine] = 2 * at + 1 + (b[mine, column[at]] > cut[at])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
            f += value[leaf]
            self.trees.append((column, cut, value))

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Probabilities that URLs are to be blocked."""
        f = np.full(len(urls), self.start)
        if self.trees and urls:
            b = self._bins(np.array([self.features(u) for u in urls]))
            row = np.arange(len(urls))
            for column, cut, value in self.trees:
                node = np.zeros(len(urls), np.int64)
                for _ in range(DEPTH):
                    node = 2 * node + 1 + (b[row, column[node]] > cut[node])
                f += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-f))


def fit(labelled: DataFrame) -> UrlModel:
    """A model of labelled(url, label 0 or 1), on at most MOST_ROWS rows by the hash of the url."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("int").alias("label"))
    n = rows.count()
    if n > MOST_ROWS:
        rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(MOST_ROWS)
    return UrlModel([(r["url"], r["label"]) for r in rows.collect()])


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    ok = F.instr(url, "://") > 0
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(ok, host).otherwise(""), F.when(ok, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules are tested in one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: len(r[0])):
        own, slash, prefix = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, threshold: float = 0.5, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, url and score of every row of pages(key, url)."""
    host, path = parts(F.col("url"))
    rows = pages.select(key, "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"))
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(batch.column("url").to_pylist()))], [*batch.schema.names, "score"])

    scored = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(key, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "url", "score")
