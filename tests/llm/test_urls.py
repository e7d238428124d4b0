from __future__ import annotations

import pytest

from cadenza.llm import entries, urls
from tests.conftest import DATA

# URLs of another source than the built-in ones.
BAD = """https://paypa1-secure-login.tk/verify/account?id=8347234 http://192.168.0.1/login.php?u=1&p=2 https://1xbet90.ru/promo http://xhamster.com/ http://pornhub.com/video
https://appleid-verify-account.com/signin http://www.chase-online-billing-update.info/login http://bit-casino777.top/ https://cheap-viagra-online.biz/order.php http://45.77.12.9:8080/x.exe
http://a8f3k2z9q1x7.xyz/a/b?clickid=33f&sub1=2&aff=9 https://free-crypto-giveaway.click/?token=abc http://secure.bankofamerica.com.update-login.cf/verify https://best-replica-watches.ru/buy
http://kjqwxzrtplm.cc/dl/setup.exe https://netfl1x-account-recovery.xyz/ https://livesex-cams24.com/join http://poker-bonus-365.bet/ http://download-warez-crack.net/keygen.zip https://www.g00gle-support.ml/signin""".split()
GOOD = """https://cheap-flights.com/ http://freebooks.example.edu/catalog https://en.wikipedia.org/wiki/Apache_Spark https://docs.python.org/3/library/re.html https://www.nytimes.com/2021/03/04/science/mars-rover.html
https://github.com/apache/spark/pull/12345 https://stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster https://www.bbc.co.uk/news/world-europe-56324891 https://arxiv.org/abs/1706.03762
https://www.essex.ac.uk/departments/history https://www.lemonde.fr/international/article/2020/01/02/le-titre_123.html https://www.amazon.com/dp/B08N5WRWNW?ref=nav http://www.winchester.gov.uk/planning https://www.alphabet.com/investor
https://www.spiegel.de/politik/deutschland/ https://news.ycombinator.com/item?id=2921983 https://www.mozilla.org/en-US/firefox/new/ https://blog.cloudflare.com/how-to-build-a-pipeline/
https://www.nature.com/articles/s41586-020-2649-2 https://recipes.timesofindia.com/us/recipes/""".split()


def test_urls_of_another_source():
    score = urls.UrlModel(urls.seed_urls()).score(BAD + GOOD)
    assert sum(score[: len(BAD)] >= 0.5) >= 18 and sum(score[len(BAD) :] < 0.5) >= 17


def test_held_out_labels():
    test = urls.seed_urls(1000, 2)
    score = urls.UrlModel(urls.seed_urls(3000, 1)).score([u for u, _ in test])
    assert sum((s >= 0.5) == bool(y) for s, (_, y) in zip(score, test, strict=True)) > 950
    assert urls.UrlModel([]).score(["http://a"]).tolist() == [0.0] or urls.UrlModel([]).score(["http://a"])[0] < 0.5


def test_fitted_from_a_table(spark):
    rows = [(f"http://site{i}.org/{'bad' if i % 2 else 'fine'}/{i}", i % 2, "more") for i in range(400)] + [(None, 1, ""), ("http://x", None, "")]
    model = urls.fit(spark.createDataFrame(rows, "url string, label int, note string"))
    score = model.score(["http://other.org/bad/1", "http://other.org/fine/1"])
    assert score[0] > 0.5 > score[1]
    assert urls.fit(spark.createDataFrame([], "url string, label int")).score(["http://a"])[0] < 0.5


def plain(url):
    """Host and path by hand."""
    _, found, rest = (url or "").partition("://")
    host = rest if found else ""
    for mark in "/?#":
        host = host.partition(mark)[0]
    path = rest[len(host) :] if found else ""
    for mark in "?#":
        path = path.partition(mark)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def by_rule(host, path, rules):
    best = (None, None)
    for text, say in rules:
        own, _, prefix = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + prefix) and len(text) > len(best[0] or ""):
            best = (text, say)
    return best


ODD = ["http://WWW.Example.ORG/es/1?q", "https://a.example.org/en/19", "http://notexample.org/es/", "http://x.com/fr", "http://x.com/fr/", "nothing", None, "http://x.org", "a://b://c/d", "://", "x://É.Org/\n/p#", "http://h.com?a=/de/", "http://h.com/de/#?", "http://" + "a" * 100_000 + ".org/", ""]


def test_rules_against_brute_force(spark):
    given = [(i, u) for i, u in enumerate(ODD)] + [(None, ODD[0]), (0, ODD[0])]
    model = urls.UrlModel(urls.seed_urls(500))
    got = urls.judge(spark.createDataFrame(given, "page_id long, url string").selectExpr("*", "1 AS rule", "'z' AS score", "'h' AS host"), entries.URL_RULES, model).collect()
    assert len(got) == len(given)
    for r in got:
        assert (r["host"], r["path"]) == plain(r["url"])
        rule, say = by_rule(r["host"], r["path"], entries.URL_RULES)
        assert r["rule"] == rule and r["score"] == model.score([r["url"]])[0]
        assert r["verdict"] == (say or ("block" if r["score"] >= 0.5 else "allow"))
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), entries.URL_RULES, model).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_the_table(spark):
    got = {r["page_id"]: r for r in entries.op2_url_filter(spark, str(DATA)).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        host, path = plain(r["url"])
        rule, say = by_rule(host, path, entries.URL_RULES)
        own = got[r["page_id"]]
        assert (own["host"], own["path"], own["rule"]) == (host, path, rule) and own["verdict"] == (say or own["verdict"])
