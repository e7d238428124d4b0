from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from cadenza.llm import html
from tests.conftest import DATA

SCHEMA = "page_id long, url string, html string"


def entropy(values, base):
    n = sum(values)
    return -sum(v / n * math.log(v / n) for v in values) / math.log(base) if base > 1 else 0.0


def test_entropies_against_brute_force(spark):
    pick = random.Random(3)
    seen = [(f"h{pick.randint(0, 2)}", pick.randint(1, 4), s := pick.randint(0, 5), 10 * s + pick.randint(0, 4)) for _ in range(400)]
    got = {(r["host"], r["node"]): r for r in html.entropies(spark.createDataFrame(seen, "host string, node long, shape long, content long")).collect()}
    groups = defaultdict(list)
    for host, node, shape, content in seen:
        groups[host, node].append((shape, content))
    assert set(got) == {k for k, v in groups.items() if len(v) > 1}
    for k, r in got.items():
        own = groups[k]
        kinds = set(own)
        assert r["pages"] == len(own)
        assert r["content"] == pytest.approx(entropy(Counter(own).values(), len(own)))
        assert r["presentation"] == pytest.approx(entropy(Counter(s for s, _ in kinds).values(), len(kinds)))


@pytest.mark.parametrize("page, want", [
    ('<article class="post hentry comments-open"><h1>T</h1><p>Body</p></article>', "T\n\nBody"),
    ('<div class="site-content has-sidebar"><h1>T</h1><p>Body</p></div>', "T\n\nBody"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title\n\nBody"),
    ('<div class="social-science paper"><p>Text</p></div>', "Text"),
    ('<div class="product-form"><p>Text</p></div>', "Text"),
    ("<p>Set <label>a label</label>, <math><mi>x</mi></math></p>", "Set a label, x"),
    ("<nav>menu</nav>", ""),
    ('<body><h1>Head</h1><p>one</p><div id="comments"><p>longer than all the rest of it together</p></div></body>', "Head\n\none"),
    ("<form><h1>a</h1><p>text</p></form>", "a\n\ntext"),
    ("a\0b &amp; &#x41;&nbsp;c<br>d<p>e<p>f", "a\0b & A c d\n\ne\n\nf"),
    ("<b>x<div>y</b>z</div>", "x\n\nyz"),
    (None, ""), ("", ""), (" \n", ""), ("<", "<"),
])
def test_single_pages(page, want):
    assert html.main_text(page) == want


def site(n, seed=1, article=lambda k, pick: [f"w{pick.randint(0, 10**6)}" for _ in range(pick.randint(3, 60))]):
    """Pages without a telling tag or class: a menu, an advert and a footer with new words on each page, and a text."""
    pick = random.Random(seed)
    out = []
    for k in range(n):
        texts = [" ".join(article(k, pick)) for _ in range(pick.randint(1, 9))]
        line = lambda m: " ".join(f"v{pick.randint(0, 10**6)}" for _ in range(m))
        menu = "".join(f"<li><a href=x>{line(1)}</a></li>" for _ in range(6))
        page = f"<body><ul>{menu}</ul><div class=k1>{line(pick.randint(6, 7))}</div><div class=k2><h2>{line(4)}</h2>{''.join(f'<p>{t}</p>' for t in texts)}<div class=k4>Ask the editor</div></div><div class=k3>&copy; {line(5)}</div></body>"
        out.append((k, "http://plain.org/%d" % k, page))
    return out


def test_entropy_alone_tells_the_text(spark):
    pages = site(40)
    for roles in (True, False):
        got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, SCHEMA), roles=roles).collect()}
        for k, _, page in pages:
            text = re.search("<div class=k2>(.*)<div class=k4>", page)[1]
            assert got[k] == "\n\n".join(x for x in re.split("<[^>]*>", text) if x)


def test_copies_keep_their_text(spark):
    """A host that shows one text on nine of ten pages."""
    pages = site(60, article=lambda k, pick: [f"w{i}" for i in range(20)] if k % 10 else [f"x{pick.randint(0, 10**6)}"])
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(" ".join(f"w{i}" for i in range(20)) in got[k] for k in got if k % 10)


def test_trees_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(site(30), SCHEMA)
    want = sorted(tuple(r) for r in html.extract(df).collect())
    monkeypatch.setattr(html, "MOST_BROADCAST", 0)
    assert sorted(tuple(r) for r in html.extract(df).collect()) == want


def test_odd_pages(spark):
    pages = [(None, None, None), (None, "http://a/", "<p>x</p>"), (1, None, ""), (1, None, "<p>same</p>"), (1, None, "<p>same</p>"), (2, "http://b", "<div>" * 3000 + "deep" + "</div>" * 3000), (3, "http://b", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "'q' AS host", "1 AS tree", "'z' AS text")
    got = sorted((r["page_id"] or 0, r["text"][:5], r["n_chars"]) for r in html.extract(df).collect())
    assert got == [(0, "", 0), (0, "x", 1), (1, "", 0), (1, "same", 4), (1, "same", 4), (2, "deep", 4), (3, "long ", 999_999)]
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("make", [lambda n: "<i>" * n + "x" + "</b>" * n, lambda n: "<b>" + "<div>" * n + "x" + "</b>" * n, lambda n: "<h2>" * n + "<li>" * n + "x", lambda n: "<![CDATA[" * n, lambda n: "<a '" * n])
def test_time_grows_with_length(make):
    took = []
    for n in (4000, 40_000):
        began = time.perf_counter()
        html.Page(make(n)).observed()
        html.main_text(make(n))
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.5


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_articles_of_the_table(spark):
    from cadenza.llm import entries

    want = {}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search("<article.*</article>", r["html"] or "", re.S)
        want[r["page_id"]] = html.main_text(inner[0] if inner else r["html"])
    got = {r["page_id"]: r["text"] for r in entries.op1_html_text(spark, str(DATA)).collect()}
    assert got == want and sum(map(bool, got.values())) > 20
