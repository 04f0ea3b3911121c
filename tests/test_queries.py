"""The engine's queries against DuckDB, over the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as driver
from cladeworks.plans import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no supplied tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = engine.QUERIES[name](spark, DATA).toPandas(), duck.execute(engine.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_entry(spark):
    r = driver.entry(spark).first()
    assert r.n_columns > 0 and r.loglik < 0


def test_em_gains(spark):
    got = engine.QUERIES["fit04_em"](spark, DATA).where("kind = 'loglik'").toPandas()
    trace = got.assign(k=got["i"].astype(int)).sort_values("k")["value"].tolist()
    assert len(trace) > 1 and all(b >= a for a, b in zip(trace, trace[1:], strict=False))


def test_eigen_and_direct_counts_agree(spark):
    a, b = (engine.QUERIES[n](spark, DATA).toPandas() for n in ("sum10_expected_counts", "sum09_direct_counts"))
    key = ["kind", "i", "j"]
    both = a.merge(b, on=key)
    assert len(both) == len(a) == len(b) and (both["value_x"] - both["value_y"]).abs().max() < 1e-3
