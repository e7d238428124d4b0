from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import mixing

DOC = "doc_id long, text string, lang string, source string"


def table(spark, n=400, seed=8):
    pick = random.Random(seed)
    texts = ["a b c", "court law law", "market Bank, price. x", "music", None, "", " \t\n", "the " * 400]
    return spark.createDataFrame([(i, pick.choice(texts), pick.choice(["en", "de", "xx", None]), f"s{pick.randint(0, 5)}") for i in range(n)], DOC)


def both(df, **kw):
    return ({r["doc_id"]: r for r in mixing.mix(df, most_cells=n, **kw).collect()} for n in (10**6, 0))


@pytest.mark.parametrize("targets", [
    {"source": 0.5, "lang": {"en": 0.6, "de": 0.3}, "topic": 1.0},
    {"source": {"s1": 0.0, "s9": 0.4, "*": 0.6}, "lang": {"en": 1.0, "de": 0.0, "*": 0.0}, "topic": 0.7},
    {"source": 1.0, "lang": {"en": 0.98, "de": 0.01, "*": 0.01}, "topic": 1.0},
])
def test_both_ways_agree(spark, targets):
    df = table(spark).withColumn("p", F.lit(7))
    a, b = both(df, targets=targets, rounds=2)
    assert len(a) == 400
    for i, r in a.items():
        assert r["weight"] == pytest.approx(b[i]["weight"], rel=1e-8, abs=1e-12) and r["sampled"] == b[i]["sampled"] and 0 <= r["p"] <= 1


def test_excluded_values(spark):
    df = spark.createDataFrame([(i, "a b", "en" if i < 10 else "de", "s") for i in range(100)], DOC)
    for got in both(df, targets={"source": 1.0, "lang": {"en": 1.0, "de": 0.0}, "topic": 1.0}, budget=0.05, rounds=1):
        assert all(r["p"] == (0.0 if r["lang"] == "de" else pytest.approx(0.5)) for r in got.values())
        assert not any(r["sampled"] for r in got.values() if r["lang"] == "de")
    for got in both(df, targets={"source": 1.0, "lang": {"en": 0.0, "de": 0.0}, "topic": 1.0}, rounds=1):
        assert not any(r["sampled"] for r in got.values())


def test_marginals_hold_under_the_cap(spark):
    pick = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(["w"] * pick.randint(5, 60)) + pick.choice([" law", "", " music"]), pick.choices(["en", "de", "fr"], [6, 3, 1])[0], f"s{min(9, int(pick.expovariate(0.5)))}") for i in range(20_000)], DOC)
    targets = {"source": 0.95, "lang": {"en": 0.5, "de": 0.32, "fr": 0.18}, "topic": 0.8}
    mixed = mixing.mix(df, targets=targets)
    for r in mixing.report(mixed, targets).collect():
        assert r["expected"] == pytest.approx(r["target"], rel=0.01)
        assert r["sampled"] == pytest.approx(r["target"], abs=0.01)
    total, expected = mixed.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("p"))).first()
    assert expected == pytest.approx(0.5 * total, rel=1e-6)
    assert mixed.where("p = 1").count() > 0  # the cap was met


def test_shortfall_is_shown(spark):
    df = spark.createDataFrame([(i, "a b c", "en" if i < 990 else "de", "s") for i in range(1000)], DOC)
    targets = {"source": 1.0, "lang": {"en": 0.5, "de": 0.5}, "topic": 1.0}
    got = {r["value"]: r for r in mixing.report(mixing.mix(df, targets=targets), targets).where("dimension = 'lang'").collect()}
    assert got["de"]["target"] == pytest.approx(0.5) and got["de"]["expected"] == pytest.approx(0.02) and got["en"]["expected"] == pytest.approx(0.98)


def test_rake_against_plain_fitting():
    """Without caps the weights are those of the textbook method."""
    pick = np.random.default_rng(1)
    tokens = pick.integers(1, 50, (4, 3, 2)).astype(float)
    want = [w / w.sum() * 0.01 * tokens.sum() for w in (pick.random(4) + 0.2, pick.random(3) + 0.2, pick.random(2) + 0.2)]
    plain = tokens.copy()
    for _ in range(300):
        for d, w in enumerate(want):
            axes = tuple(x for x in range(3) if x != d)
            plain *= (w / plain.sum(axes)).reshape([-1 if x == d else 1 for x in range(3)])
    labels = [x.reshape(-1) for x in np.indices(tokens.shape)]
    got = mixing.rake(labels, tokens.reshape(-1), want, 300)
    assert np.allclose(got * tokens.reshape(-1), plain.reshape(-1), rtol=1e-9)


def test_topics_and_tokens(spark):
    texts = ["The COURT, the law!", "law music", "music law", None, "", "\x1cx\x0by z", "nothing at all."]
    got = [tuple(r) for r in mixing.described(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").orderBy("doc_id").select("topic", "n_tokens").collect()]
    assert got == [("law", 5), ("law", 3), ("law", 3), ("other", 1), ("other", 1), ("other", 4), ("other", 4)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "one text", None, None), (None, "one text", None, None), (None, None, "en", ""), (1, "long " * 200_000, "en", "s"), (1, "long " * 200_000, "en", "s")], DOC).selectExpr("*", "'x' AS topic", "1 AS weight", "2 AS cell_source_")
    got = mixing.mix(df).collect()
    assert len(got) == 5 and all(0 <= r["p"] <= 1 and r["sampled"] is not None for r in got)
    assert len({r["sampled"] for r in got if r["doc_id"] == 1}) == 1
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.report(mixing.mix(df.limit(0))).count() == 0
