"""Every query with an SQL twin gives the twin's rows."""

import os

import duckdb
import pytest

from chronoscope import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())


def test_plans(spark, small):
    """Filters and columns reach the scan; detection is one projection without Python or shuffle."""
    from chronoscope.operators import sigma
    from chronoscope.plans.fixtures import event_log

    plan = sigma.detect(event_log(spark, small), catalog._batch())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    plan = catalog.queries()["max_lsn"](spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_no_user_is_gathered_in_one_array(spark):
    """On a table where a user has most rows, with null users and keys; the plans have no array of a user's events."""
    from collections import defaultdict

    from chronoscope import catalog

    rows = [(i, None if i % 50 == 7 else 1 if i % 3 else i % 5, None if i % 11 == 0 else i * 7 % 31) for i in range(600)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, k int").selectExpr("*", "timestamp_micros(event_id * (event_id % 4)) AS ts")
    mru, runs = defaultdict(list), defaultdict(list)
    for i, u, k in rows:
        if u is not None and i % 3 == 0:
            mru[u].append(k)
        if i % 5 and i * (i % 4):
            runs[u].append(i * (i % 4))
    want = sorted(((i, None if k is None else mru[u].index(k) if k in mru[u] else k) for i, u, k in rows if u in mru), key=str)
    found = catalog.mru_positions(e, stretch=50)
    assert sorted(map(tuple, found.collect()), key=str) == want
    counted = catalog.counted_runs(e)
    assert sorted(map(tuple, counted.collect()), key=str) == sorted(((u, t, len(r)) for u, r in runs.items() for t in r), key=str)
    for df in (found, counted):
        assert "collect_list" not in df._jdf.queryExecution().toString().lower() and "array" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_id_names_of_large_keys(spark, tmp_path):
    """Identifiers whose parts need more than 16 bits: key 65,538 of a customer isn't 2."""
    con = duckdb.connect()
    for name, sql in {"orders": "SELECT i + 65530 AS o_orderkey, 65532 + i * 1234567 AS o_custkey FROM range(40) t(i)", "events": "SELECT i AS event_id, 65532 + i * 1234567 AS user_id FROM range(50) t(i)"}.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(catalog.oracle_sql()["srum_id_names"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["srum_id_names"](spark, str(tmp_path)).collect())) == sorted(want)
