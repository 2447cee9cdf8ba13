"""Every query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = [name for plan in entry.PLANS for name in plan.QUERIES]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    plain = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(map(tuple, plain.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", PLANS)
def test_same_as_sql(spark, sf, duck, name):
    got, want = rows(entry.queries()[name](spark, sf).toPandas()), rows(duck.sql(entry.oracle_sql()[name]).df())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["n"]


def test_every_query_has_sql():
    assert set(PLANS) <= set(entry.oracle_sql())


def test_scores_read_every_row(spark, sf):
    """Answers of all orders, runs of all customers; a nation of a single run has deviation 0."""
    from pyspark.sql import functions as F

    from propgraph.operators import scoring
    from propgraph.plans import scores

    assert scores.svr_json_all(spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    runs = scores.stddev_by_group(spark, sf).agg(F.sum("runs")).first()[0]
    assert runs == spark.read.parquet(f"{sf}/customer.parquet").count()
    made = spark.createDataFrame([(1, 2.5), (2, 1.0), (2, 3.0)], "nation long, v double")
    got = {r["nation"]: (r["runs"], r["v_mean"], round(r["v_std"], 6)) for r in scoring.across_runs(made, ["nation"], ["v"]).collect()}
    assert got == {1: (1, 2.5, 0.0), 2: (2, 2.0, 1.414214)}
