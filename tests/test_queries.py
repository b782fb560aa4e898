"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from sievelight import catalog

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows) if all(None not in r for r in rows) else sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, oracle, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = oracle.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert plain([tuple(r) for r in got.select(*columns).collect()]) == plain(want)


def test_corpus_operators_are_optional():
    """Nothing outside the corpus package imports it."""
    root = os.path.dirname(os.path.dirname(catalog.__file__))
    for folder, _, files in os.walk(os.path.dirname(catalog.__file__)):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f
    assert os.path.exists(os.path.join(root, "__spark_entry__.py"))
