from __future__ import annotations

import hashlib

import duckdb
import pytest

import corpus_pipeline
from cadenza.llm import entries, neardup
from tests.conftest import DATA, rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def test_stages_keep_and_drop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, before, str(DATA)), name)
        a, b = {r["doc_id"] for r in before.select("doc_id").collect()}, {r["doc_id"] for r in after.select("doc_id").collect()}
        assert b <= a and after.count() == len(b)
        if name == "language_id":
            assert {r["doc_id"] for r in before.where("text RLIKE '[a-zA-Z]'").collect()} <= b
        if name == "near_duplicates":
            assert b == {r["doc_id"] for r in neardup.components(before).where("kept").collect()}
        if name == "benchmark_leaks":
            norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
            items = [norm(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            leaked = {r["doc_id"] for r in before.collect() if any(i in norm(r["text"]) for i in items)}
            assert not leaked & b and len(a - b) <= len(leaked) + 2
        if name != "sharding":
            assert after.columns == docs.columns
        before = after
    assert {"slot", "shard"} <= set(before.columns)
    assert rows(corpus_pipeline.run(spark, str(DATA)), "doc_id", "shard") == rows(before, "doc_id", "shard")


def test_repeated_and_missing_keys(spark):
    same = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, same), (1, same), (2, same), (3, "else"), (3, "else"), (None, same)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [0, 1, 3]


def test_leaks_without_a_key_go(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(None, f"so {item} end"), (None, "plain"), (None, None), (3, item), (3, "else"), (4, "plain")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_leaks(spark, df, str(tmp_path)).collect()) == [(0, ""), (0, "plain"), (4, "plain")]


@pytest.mark.parametrize("name", sorted(entries.oracles()))
def test_queries_with_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.execute(entries.oracles()[name]).fetchdf()
    got = entries.QUERIES[name](spark, str(DATA)).toPandas()
    plain = lambda d: sorted(tuple(f"{x:.7g}" if isinstance(x, float) else str(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


def test_edited_texts_of_the_table(spark):
    docs = sorted(rows(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text"))
    got = {r["doc_id"]: r for r in entries.op6_fingerprints(spark, str(DATA)).collect()}
    for i, (k, t) in enumerate(docs):
        edited = t[: len(t) - len(t) // 2] + docs[(i + 1) % len(docs)][1][: len(t) // 2]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
