"""Every query of the reference's operators against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from barwright.plans import library, live, market, portfolio, reports, research, screens, series, sources, strategies, streams, validation  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("null" if v is None or str(v) in ("<NA>", "NaT", "nan") else f"{v:.7g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in market.QUERIES if n in market.SQL])
def test_matches_sql(spark, sf, duck, name):
    got, want = market.QUERIES[name](spark, sf).toPandas(), duck.execute(market.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(got[cols]) == rows(want[cols])


@pytest.mark.parametrize("name", [n for n in market.QUERIES if n not in market.SQL])
def test_runs(spark, sf, name):
    assert market.QUERIES[name](spark, sf).columns


def test_infinite_is_missing(spark):
    from pyspark.sql import functions as F

    from barwright.functions.numeric import profit_factor

    r = spark.range(1).select(profit_factor(F.lit(3.0), F.lit(0.0)).alias("a"), profit_factor(F.lit(0.0), F.lit(0.0)).alias("b"), profit_factor(F.lit(3.0), F.lit(2.0)).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (None, 0.0, 1.5) and not math.isnan(r["c"])
