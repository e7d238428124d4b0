from __future__ import annotations

import duckdb
import pytest

from cadenza.plans import catalogue
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if str(value) in ("None", "nan", "NaT", "<NA>"):
        return "null"
    if isinstance(value, float) or (hasattr(value, "dtype") and value.dtype.kind == "f"):
        return f"{float(value):.9g}"
    return str(int(value)) if hasattr(value, "__int__") and not isinstance(value, str) else str(value)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    a, b = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalogue.ORACLES[name]).fetchdf()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(tuple(map(plain, r)) for r in a[columns].itertuples(index=False)) == sorted(tuple(map(plain, r)) for r in b[columns].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    catalogue.QUERIES[name](spark, str(DATA)).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", ["lines_with_refs", "nearest_block", "resolve_refs"])
def test_blocks_equal_sql_where_times_and_users_are_missing(spark, tmp_path, name):
    c = duckdb.connect()
    c.execute("""CREATE TABLE events AS SELECT * FROM (VALUES (1, 3600, 1, 'view', 0.0), (2, 9000, 1, 'view', 2.0), (3, NULL, 1, 'view', 1.0), (4, 100, 1, 'click', 1.0), (5, 3600, 1, 'click', 1.0), (6, NULL, 1, 'click', 1.0),
    (7, 50, NULL, 'view', 1.0), (8, 60, NULL, 'click', 1.0), (9, 70, 2, 'click', 0.0), (NULL, 8000, 1, 'click', 1.0)) AS t(event_id, s, user_id, event_type, value)""")
    c.execute("CREATE OR REPLACE TABLE events AS SELECT CAST(event_id AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, CAST(user_id AS BIGINT) AS user_id, event_type, CAST(value AS DOUBLE) AS value, '{}' AS props FROM events")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    a, b = catalogue.QUERIES[name](spark, str(tmp_path)), c.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(tuple(map(plain, r)) for r in a.toPandas()[list(b.columns)].itertuples(index=False)) == sorted(tuple(map(plain, r)) for r in b.itertuples(index=False))
