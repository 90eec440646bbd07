from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from millrace.plans import more, pipelines
from tests.conftest import rows

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted({*more.SQL, *pipelines.SQL, "delay_buckets", "late_rate_nation", "late_orders_top"}))
def test_query_equals_oracle(spark, small, con, name):
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    plain = lambda v: float(f"{float(v):.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    want = sorted((tuple(plain(v) for v in x) for x in r.fetchall()), key=repr)
    got = entry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(plain(v) for v in x) for x in rows(got, *names)), key=repr) == want
