"""Every query that has an oracle gives the same rows as DuckDB on the smallest tables; the others run."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from diffmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = registry.oracle_sql()


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert got == norm(found.fetchall(), names)


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    assert {"A1_review_quality", "W7_U2_rule_dedupe"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
