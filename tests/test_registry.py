"""Every query has a name, an oracle only where it exists, and scans only what it needs."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["a04_market_trends", "j04_w03_match_sales", "g02_count_within", "q05_w11_w12_comparables", "z05_daily_totals"])
def test_query_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(str, (tuple(r[columns.index(c)] for c in sorted(columns)) for r in cursor.fetchall())))
    got = sorted(map(str, (tuple(r[c] for c in sorted(columns)) for r in df.collect())))
    assert sorted(df.columns) == sorted(columns) and got == want


def test_scan_reads_only_needed_columns(spark, sf):
    plan = entry.queries()["p31_permit_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan and "PushedFilters" in plan
