"""Each query against its SQL, and published examples."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
registry = pytest.importorskip("quernstone.catalog")


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "null"
        try:
            return repr(round(float(v), 6))
        except (TypeError, ValueError):
            return str(v)[:19].removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False)), list(df.columns)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLE_SQL[name]).df())


def test_published_rating_example(spark):
    from quernstone.operators.learner import glicko_period

    games = [(1, 1500.0, 200.0, 0.06, r, rd, s) for r, rd, s in ((1400.0, 30.0, 1.0), (1550.0, 100.0, 0.0), (1700.0, 300.0, 0.0))]
    out = glicko_period(spark.createDataFrame(games, "player int, rating double, rd double, volatility double, opponent_rating double, opponent_rd double, score double")).first()
    assert (round(out.rating, 2), round(out.rd, 2), round(out.volatility, 5)) == pytest.approx((1464.05, 151.52, 0.06), abs=0.02)


def test_tracing_step(spark):
    from pyspark.sql import functions as F

    from quernstone.functions import bkt_posterior

    p = spark.range(1).select(bkt_posterior(F.lit(0.35), F.lit(True)).alias("a"), bkt_posterior(F.lit(0.35), F.lit(False)).alias("b")).first()
    assert p.a == pytest.approx(0.7078651685) and p.b == pytest.approx(0.0630630631)
