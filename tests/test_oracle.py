"""Every registered query with SQL gives the rows that the SQL gives."""

import importlib
import math

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry = importlib.import_module("presswork.plans.registry")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return str(v)
    try:
        return f"{float(v):.5g}"
    except (TypeError, ValueError):
        return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(value(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["w12_weight_fold", "l8_mmr_page", "l12_diversify", "c10_ad_reservation", "c25_html_blocks", "c27_prose_length", "e5_paired_bootstrap", "f30_content_hash_nfkc"])
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).limit(1).count() == 1
