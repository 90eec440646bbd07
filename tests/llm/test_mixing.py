from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

WORDS = {"bus": ["route", "stop", "rider", "bus"], "shop": ["price", "jacket", "seam", "buyer"], "study": ["visa", "credits", "dean", "fee"]}
TARGETS = [("even", "bus", 0.4, 1), ("even", "shop", 0.35, 2), ("even", "study", 0.25, 4), ("gap", "bus", 0.5, 2), ("gap", "press", 0.2, 3), ("gap", "study", 0.3, 2)]


def _docs(spark, sizes=(300, 120, 60), nameless=40, seed=1):
    rng = random.Random(seed)
    out = []
    for (source, words), n in zip(WORDS.items(), sizes):
        out += [(source, " ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 90])))) for _ in range(n)]
    out += [(None, " ".join(rng.choice(WORDS[s]) for _ in range(30))) for s in rng.choices(list(WORDS), k=nameless)]
    out += [("bus", ""), ("bus", None), (None, "")]
    return spark.createDataFrame([(i, t, s, 0, "x") for i, (s, t) in enumerate(out)], "doc_id bigint, text string, source string, tokens int, copies string")


def _targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs = _docs(spark)
    chosen, shares = mixing.mix_documents(docs, _targets(spark))
    by = {(r.mix_name, r.source): r for r in shares.collect()}
    for mix, source, share, cap in TARGETS:
        want = share if mix == "even" else 0.0 if source == "press" else share / 0.8
        assert abs(by[(mix, source)].planned_share - want) < 0.01
        assert abs(by[(mix, source)].reached_share - want) < 0.02
        hard = sum(r.tokens for (m, s), r in by.items() if m == mix and s)
        assert abs(by[(mix, source)].tokens / hard - want) < 0.04
    caps = {(m, s): c for m, s, _, c in TARGETS}
    rows = chosen.collect()
    assert all(1 <= r.copies <= (caps[(r.mix_name, r.source)] if r.source else 4) for r in rows)
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    own = {r.doc_id: r.source for r in docs.collect()}
    assert all(own[r.doc_id] == r.source for r in rows)
    total = sum(r.copies * r.tokens for r in rows if r.mix_name == "even")
    assert total == sum(r.tokens for (m, _), r in by.items() if m == "even")


def test_scarcest_source_is_used_to_its_cap(spark):
    docs = _docs(spark, nameless=0)
    chosen, _ = mixing.mix_documents(docs, _targets(spark, TARGETS[:3]))
    used = {r.source: r.c for r in chosen.groupBy("source").agg(F.sum("copies").alias("c")).collect()}
    have = {r.source: r["count"] for r in docs.where("length(text) > 0").groupBy("source").count().collect()}
    assert any(used[s] >= 0.99 * cap * have[s] for _, s, _, cap in TARGETS[:3])


def test_edges(spark):
    docs = _docs(spark, (5, 5, 5), 0)
    assert mixing.mix_documents(docs, _targets(spark).limit(0))[0].count() == 0
    assert mixing.mix_documents(docs.limit(0), _targets(spark))[0].count() == 0
    only = _targets(spark, [("m", "press", 1.0, 3), ("m", None, 0.5, 1), (None, "bus", 0.5, 1)])
    chosen, shares = mixing.mix_documents(docs, only)
    assert chosen.count() == 0 and [r.reached_share for r in shares.collect()] == [0.0]


def test_classifier_on_held_out_rows(spark):
    docs = _docs(spark, (200, 200, 200), 0).where("length(text) > 0")
    model = mixing.DomainModel(docs.where("doc_id % 4 <> 0"), "text", "source")
    held = model.posterior(docs.where("doc_id % 4 = 0"), "text", "p").collect()
    hits = sum(model.sources[int(np.argmax(r.p))] == r.source for r in held)
    assert hits / len(held) > 0.95 and all(abs(sum(r.p) - 1) < 1e-6 for r in held)


@pytest.mark.parametrize("seed", range(3))
def test_gradient_steps_reach_the_least_squares_optimum(spark, seed):
    rng = np.random.default_rng(seed)
    m = rng.dirichlet([1, 1, 1], size=40)
    cells = spark.createDataFrame([("x", [float(v) for v in r], 3.0, float(rng.integers(5, 90))) for r in m], "mix_name string, m array<double>, cap double, tokens double")
    import pandas as pd

    t = pd.DataFrame({"source": list("abc"), "target_share": [0.4, 0.35, 0.25], "max_repeats": [3, 3, 3], "hard_tokens": [1, 1, 1]})
    s = mixing.Mixing(steps=200, close=1e-3)
    state = mixing.fit_rates(cells, {"x": t}, s)["x"]
    off = state["expected"] - state["wanted"]
    data = cells.collect()
    r = mixing._steps(np.array([c.m for c in data]), np.array([c.cap for c in data]), state["history"], state["start"])
    assert (r >= 0).all() and (r <= 3).all()
    grad = np.array([c.m for c in data]) @ (off / state["available"])
    free = (r > 1e-6) & (r < 3 - 1e-6)
    assert np.abs(off).sum() <= 2e-2 * state["wanted"].sum() or np.abs(grad[free]).max() < 1e-2


def test_rounding_stays_close():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        tokens, rates = rng.integers(1, 400, n).astype(float), np.full(n, rng.random() * 3)
        copies = mixing.whole_copies(rates, tokens)
        assert (copies >= np.floor(rates)).all() and (copies <= np.ceil(rates)).all()
        assert abs((copies - rates) @ tokens) <= tokens.max() / 2 + 1e-6
    assert mixing.whole_copies(np.zeros(0), np.zeros(0)).tolist() == []


def test_gradient_steps_bring_equal_rates_to_the_targets(spark):
    import pandas as pd

    t = pd.DataFrame({"source": list("abc"), "target_share": [0.5, 0.3, 0.2], "max_repeats": [1, 2, 4], "hard_tokens": [1000, 400, 90]})
    lines = [("x", [float(i == j) for j in range(3)], float(c), float(n)) for i, (c, n) in enumerate(zip(t["max_repeats"], t["hard_tokens"]))]
    lines.append(("x", [0.2, 0.3, 0.1], 4.0, 50.0))
    cells = spark.createDataFrame(lines, "mix_name string, m array<double>, cap double, tokens double")
    state = mixing.fit_rates(cells, {"x": t}, mixing.Mixing())["x"]
    m, cap = np.array([x[1] for x in lines]), np.array([x[2] for x in lines])
    before = mixing._steps(m, cap, [], state["start"])
    assert np.allclose(before, np.minimum(state["start"] * m.sum(axis=1), cap)) and np.isscalar(state["start"])  # the targets play no part in where the steps start
    after = mixing._steps(m, cap, state["history"], state["start"])
    got = (after * np.array([x[3] for x in lines])) @ m
    assert state["history"] and state["done"] and state["off"] <= 1e-4
    assert np.abs(got / state["wanted"].sum() - t["target_share"]).max() < 1e-4


def test_labelled_documents_alone_take_gradient_steps(spark):
    _, shares = mixing.mix_documents(_docs(spark, nameless=0), _targets(spark))
    found = shares.collect()
    assert all(r.steps >= 1 and r.off <= 1e-4 for r in found)
