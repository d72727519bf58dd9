"""Plan shape checks and the DuckDB oracle on the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tripcast.plans import oracle as O
from tripcast.plans import queries as Q

from trip_helpers import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_nearest_vote", "knn_kth", "knn_voted", "knn_weighted", "knn_sweep", "nb_predict"])
def test_predictor_plans(spark, name):
    plan = _plan(Q.QUERIES[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, bad


def test_scan_prunes_columns(spark):
    from tripcast.sources.events import read_events
    plan = _plan(read_events(spark, SF_SMALL).select("event_id", "user_id", "ts").filter("user_id = 3"))
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in read_schema and "value" not in read_schema
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan
    # the derived trips carry only the columns the fixture needs
    plan = _plan(Q.QUERIES["hour_of_day"](spark, SF_SMALL))
    assert "props" not in plan and "event_type" not in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["r_key", "lat", "lon", "dis", "type", "k"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF_SMALL}/events.parquet'")
    return con


def _digest(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return "NULL"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return repr(float(v)) if isinstance(v, float) else str(v)
    return sorted("|".join(norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records")), cols


ORACLE = O.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    sp = Q.QUERIES[name](spark, SF_SMALL).toPandas()
    dk = duck.sql(ORACLE[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert _digest(sp) == _digest(dk)


def test_every_query_has_an_oracle():
    assert set(Q.QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())
