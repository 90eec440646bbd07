from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta
from statistics import mean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import learning, quality, reports, retrieval, series, stats, upsert
from tests.conftest import rows


# reports
def test_shares_growth_and_edges(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 30.0), ("b", 1, None)], "g string, m int, v double")
    assert rows(reports.with_share(df, "v", "s"), "s") == [(25.0,), (75.0,), (None,)]
    assert rows(reports.with_share(df, "v", "s", ["g"]), "g", "s") == [("a", 25.0), ("a", 75.0), ("b", None)]
    assert rows(reports.growth(df, "m", "v", 1, "p", ["g"]), "g", "p") == [("a", 200.0), ("a", None), ("b", None)]
    assert reports.with_share(df.limit(0), "v", "s").count() == 0
    assert reports.totals(df.limit(0), {"n": F.count(F.lit(1))}).first().n == 0


def test_gap_safe_growth_and_top(spark):
    df = spark.createDataFrame([(date(2023, 1, 1), 10.0), (date(2023, 3, 1), 20.0), (date(2024, 1, 1), 15.0)], "m date, v double")
    assert [r.p for r in reports.growth_by_month(df, "m", "v", 12, "p").orderBy("m").collect()] == [None, None, 50.0]
    ties = spark.createDataFrame([("x", 1), ("y", 1), ("z", 0)], "k string, v int")
    assert [r.k for r in reports.top(ties, 2, [F.desc("v"), F.asc("k")]).collect()] == ["x", "y"]
    assert rows(reports.top_and_bottom(ties, 1, "v", "k"), "k", "end") == [("x", "top"), ("z", "bottom")]


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, `b.c` string")
    assert rows(reports.profile(df), "column", "rows", "nulls", "distinct_values") == [("a", 3, 0, 2), ("b.c", 3, 2, 1)]
    assert rows(reports.duplicate_rows(df.withColumnRenamed("b.c", "b"))) == [(3, 2, 1)]
    assert rows(reports.duplicate_rows(df.withColumnRenamed("b.c", "b").limit(0))) == [(0, 0, 0)]


# upsert
def test_latest_and_merge(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (None, 5, "n"), (2, None, "x")], "k int, v int, s string")
    assert rows(upsert.latest_per_key(df, ["k"], ["v"])) == [(1, 2, "c"), (2, None, "x"), (None, 5, "n")]
    target = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, s string")
    source = spark.createDataFrame([(1, "new", 9), (3, "add", 8)], "k int, s string, extra int")
    assert rows(upsert.merge(target, source, ["k"])) == [(1, "new", 9), (2, "keep", None), (3, "add", 8)]
    assert rows(upsert.changes(target, source, ["k"], ["s"])) == [(1, "update"), (3, "insert")]
    assert rows(upsert.add_missing(target, source.select("k", "s"), ["k"])) == [(1, "old"), (2, "keep"), (3, "add")]
    assert rows(upsert.missing_keys(source, "k", target, "k")) == [(3,)]


def test_forward_fill(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 4.0), ("a", 3, None), ("b", 1, None)], "g string, o int, v double")
    assert rows(upsert.forward_fill(df, ["g"], "o", ["v"]), "g", "o", "v") == [("a", 1, 4.0), ("a", 2, 4.0), ("a", 3, 4.0), ("b", 1, None)]


# quality
def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "x@y", "{\"a\": 1}"), (None, -5.0, "bad", "{\"z\": 1}"), (3, None, None, None)], "id int, price double, mail string, js string")
    rules = [quality.required("id"), quality.positive("price"), quality.matching("mail", "@"), quality.only_keys("js", ["a"]), quality.castable("mail", "int"), quality.between("id", 0, 9), quality.one_of("id", [1, 3]), quality.length_between("mail", 1, 3)]
    good, bad = quality.split(df, rules[:4])
    assert rows(good, "id") == [(1,), (3,)] and "validation_errors" not in good.columns
    assert bad.first().validation_errors == "id: missing; price: not positive; mail: bad format; js: additional keys"
    assert dict(rows(quality.violations(df, rules)))["mail: not int"] == 2
    assert quality.enforce(good, rules[:4]).count() == 2
    with pytest.raises(Exception, match="contract broken: id: missing"):
        quality.enforce(df, rules[:4]).collect()
    with pytest.raises(ValueError, match="missing columns: q"):
        quality.require_columns(df, ["id", "q"])
    assert rows(quality.not_unique(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])) == [(1, 2)]
    assert quality.conditional_nulls(df, F.col("id") == 3, "price").count() == 1


def test_conditions_are_three_valued(spark):
    df = spark.createDataFrame([(3, None, "a")], "n int, m int, s string")
    spec = [{"field": "n", "op": "ge", "value": 3}, {"field": "m", "op": "lt", "value": 1}, {"field": "s", "op": "in", "value": ["b"]}, {"field": "m", "op": "exists", "name": "m there"}]
    r = df.select(quality.judge(spec).alias("j")).first().j
    assert (r.met, r.failed, r.missing) == (["n"], ["s", "m there"], ["m"])


# stats
def test_experiments():
    assert stats.sample_size(0.38, 0.02) == 9335 and stats.sample_size(0.38, 0.03) == 4167
    assert stats.sample_size(0.38, 0.02, power=0.9) > stats.sample_size(0.38, 0.02)
    assert stats.two_proportions(1000, 380, 1000, 450)["significant"] and not stats.two_proportions(100, 38, 100, 40)["significant"]
    assert round(stats.two_proportions(100, 38, 100, 41)["lift"], 4) == 0.03
    assert stats.two_proportions(0, 0, 5, 1)["p_value"] is None
    assert math.isclose(stats.t_two_sided(2.228, 10), 0.05, abs_tol=2e-4) and math.isclose(stats.t_two_sided(1.96, 1e6), 0.05, abs_tol=1e-4)
    w = stats.welch(10, 1.0, 1.0, 12, 1.0, 2.0)
    assert w["p_value"] == 1.0 and stats.welch(3, 1, 0, 3, 1, 0)["p_value"] == 1.0


def test_normal_cdf(spark):
    got = [r.p for r in spark.createDataFrame([(x / 4,) for x in range(-16, 17)], "z double").select(stats.normal_cdf(F.col("z")).alias("p")).collect()]
    assert max(abs(p - stats.NORMAL.cdf(x / 4)) for p, x in zip(got, range(-16, 17))) < 1e-6


def test_auc_and_curves(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), round(rng.random(), 1), rng.random() < 0.3) for _ in range(300)] + [("a", None, True)]
    df = spark.createDataFrame(data, "g string, s double, y boolean")
    for g, n, pos, got in rows(stats.auc(df, "s", F.col("y"), ["g"])):
        p = [s for x, s, y in data if x == g and y and s is not None]
        q = [s for x, s, y in data if x == g and not y]
        assert (n, pos) == (len(p) + len(q), len(p))
        assert math.isclose(got, sum((a > b) + (a == b) / 2 for a in p for b in q) / len(p) / len(q))
    last = stats.roc_points(df, "s", F.col("y")).orderBy("score").first()
    assert (last.tpr, last.fpr) == (1.0, 1.0)
    costs = {round(r.threshold, 2): (r.fn, r.fp) for r in stats.threshold_costs(df, "s", F.col("y"), 15000.0, 500.0).collect()}
    for t in (0.1, 0.3, 0.35, 0.89):
        assert costs[t] == (sum(y and (s is None or s < t) for _, s, y in data), sum(not y and s >= t for _, s, y in data)) or t == 0.1
    assert len(costs) == 80


def test_psi(spark):
    a = spark.createDataFrame([(float(i),) for i in range(1000)], "x double")
    assert stats.psi(a, a, "x").first().psi < 1e-6
    far = stats.psi(a, a.select((F.col("x") + 700).alias("x")), "x").first()
    assert far.status == "SIGNIFICANT"
    same = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert stats.psi(same, a, "x").first().psi == 0.0 and stats.psi(a.limit(0), a, "x").first().psi == 0.0


def test_did_equals_regression_with_hc3(spark):
    rng = np.random.default_rng(3)
    t, a = rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    y = 5 + 2 * t + 3 * a + 4 * t * a + rng.normal(size=200) * (1 + t)
    X = np.stack([np.ones(200), t, a, t * a], 1)
    inv = np.linalg.inv(X.T @ X)
    e = y - X @ (inv @ X.T @ y)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    se = math.sqrt((inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv)[3, 3])
    df = spark.createDataFrame([(bool(i), bool(j), float(k)) for i, j, k in zip(t, a, y)], "t boolean, a boolean, y double")
    got = stats.difference_in_differences(df, F.col("t"), F.col("a"), "y").first()
    assert math.isclose(got.did, (inv @ X.T @ y)[3], rel_tol=1e-9) and math.isclose(got.se, se, rel_tol=1e-9)
    assert stats.difference_in_differences(df.where("t"), F.col("t"), F.col("a"), "y").count() == 0


# series
def _line(n, f):
    return [("r", date(2024, 1, 1) + timedelta(days=i), float(f(i)), 100.0) for i in range(n)]


def test_anomalies(spark):
    rng = random.Random(0)
    data = _line(60, lambda i: 100 + rng.gauss(0, 2) + (80 if i == 40 else 0) - (70 if i == 50 else 0))
    df = spark.createDataFrame(data, "route string, d date, y double, f double")
    found = series.residual_anomalies(df, ["route"], "d", "y", "f").where("is_anomaly")
    assert rows(found, "d", "direction") == [(date(2024, 2, 10), "HIGH"), (date(2024, 2, 20), "LOW")]
    assert series.residual_anomalies(df.limit(13), ["route"], "d", "y", "f").count() == 0
    assert date(2024, 2, 10) in {r.d for r in series.baseline_anomalies(df, ["route"], "d", "y").where("is_anomaly").collect()}


def test_rolling_matches_brute_force(spark):
    data = _line(25, lambda i: (i * 7) % 11)
    df = spark.createDataFrame(data, "route string, d date, y double, f double")
    m, s = series.rolling(df, ["route"], "d", "y", 14, 7)
    got = [(r.m, r.s) for r in df.select("d", m.alias("m"), s.alias("s")).orderBy("d").collect()]
    for i, (a, b) in enumerate(got):
        part = [x[2] for x in data[max(0, i - 13) : i + 1]]
        assert (a is None) == (len(part) < 7) and (a is None or (math.isclose(a, mean(part)) and math.isclose(b, stdev(part))))


def test_forecast_errors(spark):
    df = spark.createDataFrame([("a", 100.0, 90.0), ("a", 0.0, 5.0), ("b", 0.0, 1.0), ("c", 100.0, 80.0), ("d", 100.0, 65.0), ("d", 100.0, None)], "g string, y double, f double")
    got = {r.g: r for r in series.forecast_errors(df, ["g"], "y", "f").collect()}
    assert got["a"].mae == 7.5 and got["a"].mape == 10.0 and math.isinf(got["b"].mape) and got["b"].status == "error"
    assert got["c"].status == "ok" and got["d"].status == "warning" and got["d"].n == 1


def test_gaps_and_folds(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 4)), ("a", date(2024, 1, 4)), ("b", None)], "g string, d date")
    assert rows(series.missing_days(df, ["g"], "d")) == [("a", date(2024, 1, 2)), ("a", date(2024, 1, 3))]
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-04-09')) AS d")
    folds = series.rolling_origins(days, "d", 40, 20, 10)
    assert rows(folds.groupBy("cutoff").agg(F.count_if(F.col("part") == "test").alias("n")), "n") == [(10,), (10,), (10,)]
    assert series.rolling_origins(days, "d", 400, 20, 10).count() == 0


# retrieval
DOC = "# Forms\nintro text\n\n## Steps\n- one a b\n- two c d\n  more\n- three\n- four\n- five\n\n# Other\n\nplain words here"


def test_chunks(spark):
    assert retrieval.heading_blocks(DOC)[1][0] == "Forms > Steps" and retrieval.heading_blocks(None) == []
    assert [len(w) for w in retrieval.windows(list(range(1000)))] == [380, 380, 320] and retrieval.windows([]) == []
    assert retrieval.windows(list(range(380)))[0] == list(range(380))
    packed = retrieval.pack_lines(retrieval.heading_blocks(DOC)[1][1], 8)
    assert "\n".join(packed) == retrieval.heading_blocks(DOC)[1][1] and all(len(p.split()) <= 9 for p in packed)
    df = spark.createDataFrame([(1, DOC), (2, None), (3, "  "), (4, "w " * 1000)], "id int, body string")
    got = retrieval.chunk(df, "id", "body")
    assert rows(got.groupBy("doc_id").count()) == [(1, 3), (4, 3)]
    assert got.select("chunk_id").distinct().count() == 6


def test_bm25_brute_force(spark):
    docs = [(1, "red bus stop", None), (2, "red red car", "bus"), (3, "", "x"), (4, None, "stop stop stop")]
    df = spark.createDataFrame(docs, "id int, body string, title string")
    q = spark.createDataFrame([(7, "Red BUS red"), (8, "nothing")], "qid int, t string")
    got = retrieval.bm25(df, "id", {"body": 1.0, "title": 3.0}, q, "qid", "t")
    want = {}
    for f, boost in ((1, 1.0), (2, 3.0)):
        lists = {d[0]: (d[f] or "").split() for d in docs}
        full = [x for x in lists.values() if x]
        avg = sum(map(len, full)) / len(full)
        for i, w in lists.items():
            s = 0
            for t in ("red", "bus"):
                n = sum(t in x for x in lists.values())
                if t in w:
                    s += math.log(1 + (len(full) - n + 0.5) / (n + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg))
            if s:
                want[i] = max(want.get(i, 0), s * boost)
    assert {r.doc_id: round(r.score, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_cosine_and_fusion(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(300, [0.0] * 8), (301, None), (302, [1.0]), (303, [float(x) for x in m[0]])]
    df = spark.createDataFrame(data, "id int, v array<double>")
    got = retrieval.cosine_top_k(df, "id", "v", df.where("id % 50 = 0 AND id < 300"), "id", "v", 5, block=4)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        best = sorted(range(300), key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:5]
        mine = [r.key for r in got.where(f"query_id = {q}").orderBy("position").collect()]
        assert set(mine) - {303} <= set(best)
    assert [r.key for r in got.where("query_id = 0").orderBy("position").limit(2).collect()] == [0, 303]
    assert retrieval.cosine_top_k(df, "id", "v", df.limit(0), "id", "v").count() == 0
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, d string, position int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, d string, position int")
    fused = retrieval.reciprocal_rank_fusion([a, b], "d").orderBy("position").collect()
    assert [r.d for r in fused] == ["y", "x"] and math.isclose(fused[0].score, 1 / 62 + 1 / 61)
    merged = retrieval.merge_lists([a, b], ["d"], ["query_id"], 2)
    assert rows(merged, "d", "position") == [("x", 1), ("y", 2)]
    pairs = retrieval.token_cosine(a.withColumn("t", F.lit("p q q")), "position", "t", b.withColumn("t", F.lit("q")), "position", "t")
    assert math.isclose(pairs.first().similarity, 2 / math.sqrt(5))
    hits = spark.createDataFrame([(1, 5, 1.0, "fee list", 1), (1, 6, 0.9, "Visa desk", 2)], "query_id int, doc_id int, score double, t string, position int")
    assert retrieval.rerank(hits, F.col("t"), [("visa", 0.25), ("fee", -0.4)]).orderBy("position").first().doc_id == 6


# learning
def test_splits_and_features(spark):
    df = spark.createDataFrame([(i, i % 5 == 0, float(i) if i % 7 else None, ["lo", "hi", None][i % 3], "ab"[i % 2], date(2024, 1, 1) + timedelta(days=i)) for i in range(1000)], "id int, y boolean, n double, o string, c string, d date")
    train, test = learning.stratified_split(df, "id", "y")
    assert train.count() + test.count() == 1000
    for flag, n in ((True, 200), (False, 800)):
        assert abs(train.where(F.col("y") == flag).count() - 0.8 * n) <= 0.03 * n
    a, b = learning.temporal_split(df, "d", 28)
    assert b.count() == 28
    f = learning.Features(["n"], {"o": ["lo", "hi"]}, ["c"]).fit(train)
    new = spark.createDataFrame([(1, None, "odd", None)], "id int, n double, o string, c string")
    v = f.transform(new).first().features.toArray()
    assert len(v) == 5 and not np.isnan(v).any() and v[1] == -1.0


def test_training_and_report(spark, tmp_path):
    rng = random.Random(2)
    data = [(i, rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, int(a + b > 1)) for i, a, b in data], "id int, a double, b double, y int")
    ready = learning.Features(["a", "b"]).fit(df)
    learning.save(ready.model, str(tmp_path / "m"))
    assert learning.load(str(tmp_path / "m")).stages
    x = ready.transform(df)
    train, test = learning.stratified_split(x, "id", "y")
    models, table = learning.compare_models(train, test, "y", ["logistic"], 10.0, 1.0)
    assert table.first().auc > 0.95
    pred = learning.probability(models["logistic"], test).withColumn("p", (F.col("score") > 0.5).cast("int"))
    report = learning.class_report(pred, "y", "p")
    assert learning.macro_f1(report).first().macro_f1 > 0.85
    assert learning.importances(df, ["a", "b"], "y").count() == 2
