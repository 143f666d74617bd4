"""Registered queries against their SQL, on the smallest tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from twinlens.plans import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, db, name):
    got = catalogue.queries()[name](spark, sf)
    want = db.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got.select(columns).collect()) == plain(want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_simulations_are_those_of_the_reports(spark, sf):
    from twinlens.plans.evaluate import Options

    assert catalogue.SIMULATIONS == Options.n_simulations
    assert "simulate_pmse" in catalogue.queries()
    for plan in (catalogue.ORDERS, catalogue.PART, catalogue.CUSTOMER):
        rows = catalogue._numbered(spark, sf, plan)
        assert rows.count() == spark.read.parquet(f"{sf}/{plan.table}.parquet").count() == rows.agg({"row_id": "max"}).first()[0] + 1
