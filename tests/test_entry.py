from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import rows


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_flagship(spark):
    assert entry.entry(spark).columns == ["month", "revenue", "orders", "growth"]


@pytest.mark.parametrize("name", ["monthly_revenue", "revenue_by_category", "customer_kpis", "auc_by_group", "rolling_anomalies", "p2_found", "p3_found", "p5_found"])
def test_query_equals_oracle(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    plain = lambda v: float(f"{float(v):.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    want = sorted((tuple(plain(v) for v in x) for x in r.fetchall()), key=repr)
    got = entry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(plain(v) for v in x) for x in rows(got, *names)), key=repr) == want


def test_spikes_on_small_tables(spark, small):
    found = entry.queries()["p1_found"](spark, small)
    assert found.dtypes == [("route", "string"), ("service_date", "string")]
    assert found.count() == found.distinct().count()
