"""Every registered query with SQL against DuckDB on the smallest tables; the others must give rows twice alike."""

import math

import duckdb
import pytest

from epochlake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.7g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if v.isoformat()[10:] in ("", "T00:00:00") else v.isoformat()
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_repeats(spark, name):
    first = QUERIES[name](spark, SF)
    a = table(first.columns, [tuple(r) for r in first.collect()])
    second = QUERIES[name](spark, SF).repartition(7)
    assert a and a == table(first.columns, [tuple(r) for r in second.collect()])


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
