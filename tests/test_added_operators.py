from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, numbers, text
from millrace.operators import learning, quality, retrieval, series, sessions, stats
from millrace.sources import readers
from millrace.streaming import pipeline
from tests.conftest import rows


def test_percentiles_equal_those_of_the_sorted_values(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.choice([None, float("nan"), -5.0, 0.0, 3.0, rng.uniform(-1e6, 1e6)])) for _ in range(400)] + [("c", None)]
    got = {r.k: r.percentiles for r in stats.percentiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", [0.0, 0.25, 0.5, 0.95, 1.0]).collect()}
    for k in "ab":
        own = [v for g, v in data if g == k and v is not None and not math.isnan(v)]
        assert np.allclose(got[k], np.quantile(own, [0.0, 0.25, 0.5, 0.95, 1.0]))
    assert set(got) == {"a", "b"}
    assert stats.percentiles(spark.createDataFrame([], "v double"), [], "v", [0.5]).count() == 0


def test_session_starts_by_brute_force(spark):
    rng = random.Random(3)
    base = datetime(2024, 1, 1, 20)
    data = [(rng.choice([1, 1, 2, None]), base + timedelta(minutes=rng.randrange(0, 6000, 30))) for _ in range(150)] + [(1, None)]
    got = sessions.with_session_start(spark.createDataFrame(data, "u bigint, t timestamp_ntz"), "u", "t", 3600)
    want = []
    for u in (1, 2):
        last = start = None
        for t in sorted(t for v, t in data if v == u and t):
            if last is None or t - last >= timedelta(hours=1):
                start = t
            last = t
            want.append((u, t, int((start - datetime(1970, 1, 1)).total_seconds() * 1e6)))
    assert rows(got, "u", "t", "session") == sorted(want, key=repr)


def test_forecast_of_each_series(spark):
    start = date(2023, 1, 1)
    shape = lambda i, level: level * (1.5 if (start + timedelta(days=i)).weekday() < 5 else 0.8)
    data = [(k, start + timedelta(days=i), shape(i, level) if i < 300 else None, float(i % 3)) for k, level in (("a", 100.0), ("b", 900.0)) for i in range(328)]
    data += [("c", start, 5.0, None), (None, start, 1.0, 1.0), ("a", None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "k string, day date, v double, rain double")
    got = learning.series_forecast(df, "k", "day", "v", str(start + timedelta(days=299)), 28, ["rain"]).collect()
    assert len(got) == 56 and {r.k for r in got} == {"a", "b"}
    for r in got:
        want = shape((r.day - start).days, 100.0 if r.k == "a" else 900.0)
        assert abs(r.forecast - want) < 0.05 * want and r.low <= r.forecast <= r.high


def test_made_up_rows_lie_between_rows_of_their_class(spark):
    rng = random.Random(5)
    data = [(i, rng.uniform(0, 1), rng.uniform(5, 6), 1) for i in range(20)] + [(100 + i, 50.0, 50.0, 0) for i in range(200)] + [(300, None, 5.5, 1)]
    out = learning.synthetic_minority(spark.createDataFrame(data, "id int, x double, y double, label int"), "id", ["x", "y"], "label", 1, 3)
    made = out.where("id IS NULL").collect()
    assert len(made) == 63 and all(r.label == 1 and 5 <= r.y <= 6 and (r.x is None or 0 <= r.x <= 1) for r in made)
    empty = learning.synthetic_minority(spark.createDataFrame([], "id int, x double, label int"), "id", ["x"], "label", 1)
    assert empty.count() == 0


def test_headings_of_all_levels():
    body = "intro\n# A\none\n### B\ntwo\n## C\n\n## D\nthree\n#no title\n# E  \nfour"
    assert retrieval.heading_blocks(body) == [("", "intro"), ("A", "one"), ("A > B", "two"), ("A > D", "three\n#no title"), ("E", "four")]
    assert retrieval.heading_blocks(None) == [] and retrieval.heading_blocks(" \n#######  x") == [("", "#######  x")]


def test_vector_search_in_blocks_with_ties(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(120)] + [(500, None), (501, [1.0]), (502, [0.0] * 4)]
    v = spark.createDataFrame(data, "id int, v array<double>").repartition(5)
    asked = v.where("id % 10 = 0")
    got = rows(retrieval.cosine_top_k(v, "id", "v", asked, "id", "v", 3, block=4), "query_id", "key", "position")
    full = {i: np.array(x) for i, x in data if x and len(x) == 4 and any(x)}
    want = []
    for q in sorted(i for i in full if i % 10 == 0):
        near = sorted(full, key=lambda k: (-round(float(full[q] @ full[k] / np.linalg.norm(full[q]) / np.linalg.norm(full[k])), 12), k))
        want += [(q, k, n + 1) for n, k in enumerate(near[:3])]
    assert [(q, p) for q, _, p in got] == [(q, p) for q, _, p in sorted(want, key=repr)]
    assert sum(g in want for g in got) >= len(want) - 4  # rounding may order equal similarities otherwise


def test_bm25_is_the_same_for_few_and_many_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red bus stop"), (2, "bus bus"), (3, None), (4, "blue stop")], "id int, text string")
    asked = spark.createDataFrame([(1, "bus stop"), (2, "blue")], "id int, q string")
    few = rows(retrieval.bm25(docs, "id", {"text": 1.0}, asked, "id", "q"))
    monkeypatch.setattr(retrieval, "FEW_TERMS", 1)
    assert rows(retrieval.bm25(docs, "id", {"text": 1.0}, asked, "id", "q")) == few and len(few) == 4


def test_filled_series_takes_the_value_before_then_the_one_after(spark):
    start = date(2024, 1, 20)
    data = [("a", start + timedelta(days=i), v) for i, v in enumerate([None, None, 3, None, *[None] * 40, 7, None])]
    got = [r.v for r in series.filled(spark.createDataFrame(data, "k string, day date, v int"), ["k"], "day", "v").orderBy("day").collect()]
    assert got == [3] * 44 + [7, 7]


def test_small_functions(spark):
    df = spark.createDataFrame([("the drivers moved", "about 12 days, or 3 weeks", 2.345, date(2024, 2, 12))], "a string, b string, x double, d date")
    amount, unit = text.duration(F.col("b"))
    r = df.select(
        text.lemmas(F.col("a"), {"drivers": "driver"}).alias("l"), amount.alias("n"), unit.alias("u"), numbers.half_up(F.col("x"), 1).alias("h"), dates.state_holiday(F.col("d"), "IL").alias("s"),
        text.one_of(F.lit(None).cast("string"), {"x": "x"}).alias("none"), text.link_label(F.lit("https://a.b/c/the_bus-stop.html?x=1")).alias("label"),
        numbers.merged_maps(F.create_map(F.lit("k"), F.lit("v")), F.create_map(F.lit("k"), F.lit(" "), F.lit("m"), F.lit("w"))).alias("m"),
    ).first()
    assert (r.l, r.n, r.u, r.h, r.s, r.none, r.label, r.m) == ("the driver moved", 12, "day", 2.3, True, None, "the bus stop", {"k": "v", "m": "w"})


def test_hits_without_the_wanted_topic_fall_back_to_all(spark):
    data = [(1, 1, 1, 9.0, "x"), (1, 2, 2, 8.0, "y"), (2, 3, 1, 5.0, None), (2, 4, 2, 4.0, "y")]
    hits = spark.createDataFrame(data, "query_id int, doc_id int, position int, score double, topic string")
    got = rows(retrieval.with_fallback(hits, F.col("topic") == "x", F.lit(5)), "query_id", "doc_id", "position")
    assert got == [(1, 1, 1), (2, 3, 1), (2, 4, 2)]


def test_answers_and_payloads_that_break_contracts(spark):
    said = spark.createDataFrame([('x {"score": 11} y',), (None,), ('{"score": 5}',)], "t string")
    rules = [("score: out of range", lambda o: o["score"].between(1, 10))]
    got = [(r.c.success, r.c.error) for r in said.select(quality.checked_object(F.col("t"), "score int", rules).alias("c")).collect()]
    assert got == [(False, "score: out of range"), (False, "no object"), (True, None)]
    answers = spark.createDataFrame([(False, None), (True, "quota")], "error boolean, reason string")
    assert readers.checked_payload(answers.where("NOT error"), "error", "reason").count() == 1
    with pytest.raises(Exception, match="quota"):
        readers.checked_payload(answers, "error", "reason").collect()


def test_failed_lookups_are_not_asked_again(spark):
    facts = spark.createDataFrame([(1, "a")], "k int, v string")
    asked = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    hits, memory = pipeline.looked_up(asked, "k", facts)
    assert rows(hits) == [(1, "a")] and rows(memory) == [(1, True), (2, False)]
    again, memory = pipeline.looked_up(asked, "k", spark.createDataFrame([(2, "late")], "k int, v string"), memory)
    assert again.count() == 0 and rows(memory) == [(1, True), (2, False)]


def test_index_finds_what_the_exact_search_finds(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = v.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.key) for r in retrieval.cosine_top_k(v, "vec_id", "embedding", asked, "vec_id", "embedding", 10).collect()}
    index = retrieval.VectorIndex(v, "vec_id", "embedding")
    assert index.rows.count() == v.count()
    found = {(r.query_id, r.key) for r in index.search(asked, "vec_id", "embedding", 10).collect()}
    recall = len(exact & found) / len(exact)
    print("recall", recall)
    assert recall >= 0.9


def test_index_of_nothing_and_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0])], "id int, v array<double>")
    index = retrieval.VectorIndex(v, "id", "v", lists=2)
    assert rows(index.search(v, "id", "v", 1, 2), "query_id", "key") == [(1, 1), (5, 5)]
    assert retrieval.VectorIndex(v.limit(0), "id", "v").search(v, "id", "v").count() == 0


def test_text_vectors_of_like_texts_are_alike(spark):
    d = spark.createDataFrame([(1, "red bus stop near the school"), (2, "the red bus stop near a school"), (3, "funding round led by investors"), (4, ""), (5, None)], "id int, t string")
    v = {r.id: r.vector for r in learning.text_vectors(d, "t").collect()}
    assert v[4] is None and v[5] is None
    assert np.dot(v[1], v[2]) > 0.6 > np.dot(v[1], v[3])


def test_token_windows_overlap_and_fit(spark):
    from millrace.functions.encoding import VOCABULARY, token_windows, vocabulary

    text_ = " ".join(f"word{i} größer" for i in range(300))
    ids = vocabulary().encode_ordinary(text_)
    got = token_windows(text_, 100, 10)
    assert all(n <= 100 for _, n in got) and len(got) == len(range(0, len(ids) - 10, 90))
    assert got[0][0] == text_[: len(got[0][0])] and got[-1][0].endswith("größer")
    assert token_windows("", 5, 1) == [] and token_windows("short", 5, 1) == [("short", 1)]
    docs = spark.createDataFrame([(1, "# A\n" + text_), (2, None), (3, "\n".join(f"- item {i}" for i in range(8)))], "id int, t string")
    rows_ = retrieval.chunk(docs, "id", "t", 100, 10, VOCABULARY).collect()
    assert max(r.words for r in rows_) <= 100 and {r.doc_id for r in rows_} == {1, 3} and sum(r.doc_id == 3 for r in rows_) == 1


def _most_shuffled(df) -> int:
    """Rows written by the largest exchange of a collected plan."""

    def of(node) -> int:
        found = node.metrics().get("shuffleRecordsWritten")
        own = found.get().value() if found.isDefined() else 0
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in kind else [node.children().apply(i) for i in range(node.children().size())]
        return max([own, *map(of, below)])

    return of(df._jdf.queryExecution().executedPlan())


def test_bm25_of_many_terms_shuffles_the_best_only(spark):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(["all", *(f"w{j}" for j in rng.integers(0, 1500, 30))]) for i in range(400)}
    texts |= {i: texts[i - 400] for i in range(400, 420)}
    docs = spark.createDataFrame([*texts.items(), (500, None), (None, "all w1"), (0, texts[0])], "id int, text string").repartition(4)
    asked = docs.where("id < 420 AND id % 10 = 0").dropDuplicates(["id"])
    found = retrieval.bm25(docs, "id", {"text": 1.0}, asked, "id", "text", 3)
    got = {(r.query_id, r.position): (r.doc_id, r.score) for r in found.collect()}
    assert _most_shuffled(found) < 42 * 420 / 4
    rows_ = [(i, t.split()) for i, t in texts.items()] + [(0, texts[0].split()), (None, ["all", "w1"])]
    df = {}
    for _, w in rows_:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    n, mean = len(rows_), sum(len(w) for _, w in rows_) / len(rows_)
    want = {}
    for q in range(0, 420, 10):
        s = {}
        for i, w in rows_[:-1]:
            s[i] = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(texts[q].split()) if t in w)
        for p, i in enumerate(sorted((i for i in s if s[i] > 0), key=lambda i: (-round(s[i], 9), i))[:3], 1):
            want[(q, p)] = i, s[i]
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_bm25_in_blocks_and_pieces_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(f"w{min(int(x), 900)}" for x in rng.exponential(120, 60))) for i in range(200)], "id string, text string")
    asked = docs.where("substr(id, 4, 1) = '0'")
    whole = rows(retrieval.bm25(docs, "id", {"text": 1.0}, asked, "id", "text"), "query_id", "position", "doc_id")
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "PIECE", 100)
    monkeypatch.setattr(retrieval.BlockOfQueries, "PAIRS", 50)
    assert rows(retrieval.bm25(docs, "id", {"text": 1.0}, asked, "id", "text"), "query_id", "position", "doc_id") == whole
    monkeypatch.setattr(retrieval, "FEW_TERMS", 10_000)
    assert rows(retrieval.bm25(docs, "id", {"text": 1.0}, asked, "id", "text"), "query_id", "position", "doc_id") == whole and len(whole) == 200


def test_equal_vectors_are_ordered_by_key_whatever_their_place(spark):
    rng = np.random.default_rng(6)
    kinds = rng.normal(size=(7, 64))
    v = spark.createDataFrame([(i, [float(x) for x in kinds[i % 7]]) for i in range(600)] + [(600, [float("inf")] * 64)], "id int, v array<double>")
    got = rows(retrieval.cosine_top_k(v.repartition(5), "id", "v", v.where("id < 7"), "id", "v", 20), "query_id", "position", "key")
    assert got == sorted(((q, n + 1, q + 7 * n) for q in range(7) for n in range(20)), key=repr)


def test_hybrid_search_projects_each_text_once(spark, small, monkeypatch):
    import __spark_entry__ as entry
    from millrace.plans import more

    kept = []
    monkeypatch.setattr(more, "cut", lambda df: kept.append(df.columns) or df.localCheckpoint())
    found = entry.queries()["hybrid_search"](spark, small)
    assert kept == [["doc_id", "vector"]] and "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
