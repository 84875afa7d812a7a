"""Registered queries agree with their oracle SQL; the entry query runs."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lacuna.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_against_oracle(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    expected = sorted([plain(r[names.index(c)]) for c in key] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in key] for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
