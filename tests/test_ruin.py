"""Accounts that lose all of their capital: queries and their SQL state the same rules."""

from __future__ import annotations

import duckdb
import pytest

from barloom.plans import ORACLES, QUERIES
from tests.test_queries import compare


@pytest.fixture(scope="module")
def ruined(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ruined"))
    rows = spark.range(360_000).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_partkey", "id % 3 AS l_suppkey", "cast(1 + id % 2 AS int) AS l_linenumber", "double(1) AS l_quantity", "double(id % 11) AS l_extendedprice",
        "(id % 5) / 100D AS l_discount", "0.08D AS l_tax", "'R' AS l_returnflag", "if(id % 3 = 0, 'O', 'F') AS l_linestatus", "timestamp_ntz'1996-01-01' + make_dt_interval(cast(id div 1000 AS int)) AS l_shipdate",
    )
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["W18_daily_returns", "W19_rolling_mean", "M3_core_metrics", "M4_sample_shape", "M5_tail_ratio", "M9_cost_sensitivity", "M10_hac_t", "M11_slope"])
def test_against_sql_after_ruin(spark, ruined, name):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view lineitem as select * from '{ruined}/lineitem.parquet/*.parquet'")
    compare(QUERIES[name](spark, ruined).toPandas(), con.execute(ORACLES[name]).df())


def test_account_that_ends_at_nothing(spark):
    """Ten losses of a tenth leave nothing, not the 1e-16 that their floating-point sum does."""
    import datetime as dt

    from barloom.operators.metrics import daily_returns

    days = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), -0.1) for k in range(12)]
    got = daily_returns(spark.createDataFrame(days, "k string, day date, pnl double"), ["k"], 1.0).orderBy("day").collect()
    assert [r.equity for r in got[8:11]] == [0.1, 0.0, -0.1]
    assert [round(r.ret, 9) for r in got[8:]] == [-0.5, -1.0, 0.0, 0.0]


def test_shape_of_a_long_series_after_ruin(spark):
    """One great loss and then nothing for 150,000 days: twelve digits of the kurtosis hold, whatever the order of the rows."""
    import math

    from barloom.operators.metrics import sample_shape

    days = "case when id < 2000 then (id * 7919 % 2003 - 1000) / 1e5 when id = 2000 then -2900D when id = 2001 then 37D else 0D end"
    rows = spark.range(152_002, numPartitions=3).selectExpr("'a' AS k", f"double({days}) AS ret")
    odd = spark.createDataFrame([("b", 0.1)] * 7 + [("b", None), ("c", None), ("d", 1.0), ("d", 1.0), ("d", 2.0), ("d", 6.0), ("d", None)], "k string, ret double")
    got = {r.k: r for r in sample_shape(rows.union(odd), ["k"], "ret").collect()}
    x = [(i * 7919 % 2003 - 1000) / 1e5 for i in range(2000)] + [-2900.0, 37.0] + [0.0] * 150_000
    n, mean = len(x), math.fsum(x) / len(x)
    m2, m3, m4 = (math.fsum((v - mean) ** p for v in x) / n for p in (2, 3, 4))
    assert got["a"].n == n
    assert abs(got["a"].skew - m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)) < 1e-10
    assert abs(got["a"].excess_kurtosis - ((n + 1) * (m4 / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))) < 5e-9
    assert (got["b"].n, got["b"].skew, got["b"].excess_kurtosis) == (7, None, None)
    assert (got["c"].n, got["c"].skew, got["c"].excess_kurtosis) == (0, None, None)
    assert got["d"].n == 4 and math.isclose(got["d"].skew, 9 / 4.25**1.5 * math.sqrt(12) / 2)
