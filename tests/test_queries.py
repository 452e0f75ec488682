"""Every query with SQL against DuckDB on the same tables, and the shape of the others."""

import math

import duckdb
import pytest

from tidemark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want and got


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(QUERIES) - set(ORACLES) == {
        "a14_forecast_document", "d14_coefficients", "d20_block_bootstrap", "e15_garch", "e22_multi_horizon_garch", "e27_kitchen_sink", "i06_stream_garch", "k11_implied_against_garch", "k12_macro_question_garch",
        "k13_point_leaderboard_all", "k14_distribution_leaderboard_garch", "k16_elastic_net", "k30_predictive_quantiles", "k31_common_window_garch",
    }


@pytest.mark.parametrize("name", ["c01_master", "c09_latest_valid", "g01_date_sets"])
def test_big_tables_are_scanned_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(f"/{t}.parquet") for t in ("orders", "lineitem")] == [1, 1]
