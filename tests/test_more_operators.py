from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import reports, series, stats
from tests.conftest import rows


def test_trailing_count_brute_force(spark):
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1)
    data = [(i, rng.choice("ab"), t0 + timedelta(seconds=rng.choice([0, 3600, 3599]) * rng.randrange(4) + rng.randrange(0, 9000, 100))) for i in range(150)]
    data += [(900, None, t0), (901, "a", None)]
    df = spark.createDataFrame(data, "id int, k string, at timestamp_ntz")
    want = {i: sum(k2 == k and timedelta(0) <= t - t2 < timedelta(hours=1) for _, k2, t2 in data if t2) for i, k, t in data if k and t}
    assert {r.id: r.n for r in series.trailing_count(df, "k", "at", 3600, "n").collect()} == want


def test_sampling_and_order(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    a = reports.hash_sample(df, ["id"], 0.2)
    assert abs(a.count() - 1000) < 120 and rows(a) == rows(reports.hash_sample(df, ["id"], 0.2))
    kept = {r.g for r in reports.hash_sample(df, ["g"], 0.5).select("g").distinct().collect()}
    assert all(reports.hash_sample(df, ["g"], 0.5).where(F.col("g") == g).count() == df.where(F.col("g") == g).count() for g in kept)
    days = spark.createDataFrame([("Sun",), ("Mon",), ("?",), ("Tue",)], "d string")
    assert [r.d for r in reports.in_list_order(days, "d", ["Mon", "Tue", "Sun"]).collect()] == ["Mon", "Tue", "Sun", "?"]


def test_profiles_and_copies(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0), (2, None, 5.0), (3, 0.0, 0.0)], "k int, a double, b double")
    assert rows(reports.row_profile(df, ["a", "b"])) == [(1, 0.5, 1.0), (2, None, 1.0), (3, None, None)]
    texts = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c"), (4, None), (5, None)], "id int, t string")
    assert rows(reports.near_copies(texts, "id", F.trim(F.regexp_replace(F.lower("t"), r"\s+", " ")))) == [(1, 1, 2), (2, 1, 2)]


def test_monitoring(spark):
    xs = [round(random.Random(3).random(), 2) for _ in range(1)] + [i / 37 for i in range(37)] + [0.5] * 5
    df = spark.createDataFrame([(x, "hi" if x > 0.5 else "lo") for x in xs] + [(None, "lo")], "s double, b string")
    r = stats.monitoring(df, "s", F.col("s") > 0.5, F.col("b")).first()
    assert r.n == len(xs) and r.p95 == sorted(xs)[int(len(xs) * 0.95)] and r.distribution == {"hi": sum(x > 0.5 for x in xs), "lo": sum(x <= 0.5 for x in xs)}


def test_drift_gates(spark):
    a = spark.createDataFrame([(float(i), float(i)) for i in range(200)], "x double, y double")
    few = a.limit(60).withColumn("y", F.when(F.col("x") < 5, F.col("y")))
    assert [r.column for r in stats.drift_report(a, few, ["x", "y"]).collect()] == ["x"]
    assert stats.drift_report(a, a.limit(20), ["x"]).count() == 0


def test_last_rows_mean(spark):
    df = spark.createDataFrame([("a", i, float(i) if i != 9 else None) for i in range(10)], "g string, o int, v double")
    assert rows(series.last_rows_mean(df, ["g"], "o", ["v"], 3)) == [("a", 7.5)]
