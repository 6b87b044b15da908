"""A quick pass over the contract at the smallest scale; tools/check.py compares every query with its SQL."""

import duckdb
import pytest

import __spark_entry__ as contract
from fixtures import RAW_TABLES
from tools.check import canonical

SF = "/root/testdata/sf0.001"
SAMPLE = ("infer_schedules", "a05_zone_fare_matrix", "j05_edges_along_trips", "m02_drop_spikes", "l05_resolve_edge_votes", "l18_notification_history", "n04_graph_stats", "m08_resample_even")


def test_names():
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150


def test_entry(spark):
    assert "headway_min" in contract.entry(spark).columns


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in RAW_TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    cur = db.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), cols)


def test_every_report_reaches_its_subscribers(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").collect()
    people = [r["c_custkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").where("c_acctbal >= 0").collect()]
    want = sorted((e["event_id"], p) for e in events for p in people if p % 5 == e["user_id"] % 5 and p != e["user_id"])
    assert sorted(map(tuple, contract.queries()["j15_subscribers"](spark, SF).collect())) == want
