from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing
from millrace.llm.tokens import encode, token_counts

CAPACITIES = {"short": 64, "long": 200}


def _naive(sizes, capacity):
    """The sum-of-squares rule by trying every level and adding up all squares."""
    fills, where = [], []
    for s in sizes:
        best = None
        for h in range(capacity - s, -1, -1):
            if h and h not in [f for f in fills if f < capacity]:
                continue
            trial = Counter(f for f in fills if f < capacity)
            if h:
                trial[h] -= 1
            if h + s < capacity:
                trial[h + s] += 1
            cost = sum(v * v for k, v in trial.items() if k)
            if best is None or cost < best[0]:
                best = (cost, h)
        h = best[1]
        at = max(i for i, f in enumerate(fills) if f == h) if h else len(fills)
        if not h:
            fills.append(0)
        fills[at] += s
        where.append(at)
    return where, fills


@pytest.mark.parametrize("seed", range(4))
def test_rule_equals_trying_everything(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = [rng.randint(1, capacity) for _ in range(120)]
    where, fills = packing.sum_of_squares(np.array(sizes), capacity)
    levels = Counter()
    _, naive = _naive(sizes, capacity)
    assert sorted(fills.tolist()) == sorted(naive)
    for w, s in zip(where, sizes):
        levels[w] += s
    assert [levels[i] for i in range(len(fills))] == fills.tolist() and max(fills) <= capacity


def _docs(spark):
    rng = random.Random(5)
    words = ["bus", "naïve", "größer", "🚌", "zip", "\n\n", "don't", "12", "word"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20, 60, 400]))) for _ in range(150)]
    texts += ["", None, "   ", "🚌" * 300, "a" * 5000, texts[0], texts[0], "<|endoftext|> is plain"]
    return texts, spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, p string, used int")


def test_containers_hold_every_text_whole(spark):
    texts, docs = _docs(spark)
    placed = packing.packed_texts(docs, "doc_id", "text", CAPACITIES, group_items=60).cache()
    got = {}
    for r in placed.collect():
        got.setdefault((r.pack_name, r.doc_id), []).append((r.piece_no, r.text, r.tokens))
    for name, capacity in CAPACITIES.items():
        for i, t in enumerate(texts):
            parts = sorted(got.pop((name, i), []))
            size = len(encode(t)) if t else 0
            assert "".join(p[1] for p in parts) == (t or "") and [p[0] for p in parts] == list(range(len(parts)))
            assert all(p[2] == len(encode(p[1])) <= capacity for p in parts)
            assert (len(parts) > 1) == (size > capacity)
    assert not got
    full = packing.containers(placed).collect()
    assert all(0 <= c.unused_tokens == c.capacity_tokens - c.used_tokens for c in full)
    assert placed.where(F.col("used_tokens") + F.col("unused_tokens") != F.col("capacity_tokens")).count() == 0
    for name, capacity in CAPACITIES.items():
        own = [c for c in full if c.pack_name == name]
        assert len(own) <= 1.05 * sum(c.used_tokens for c in own) / capacity + 1


def test_rounds_leave_little_unused(spark):
    rng = random.Random(7)
    rows = [("p", 512, i, 0, 0, 1, min(512, 1 + int(rng.expovariate(1 / 120)))) for i in range(6000)]
    df = spark.createDataFrame(rows, packing.ITEMS)
    used = packing.pack(df, group_items=1000).select("container", "used", "capacity").distinct()
    r = used.agg((1 - F.sum("used") / F.sum("capacity")).alias("waste")).first()
    assert r.waste < 0.01


def test_nothing_to_pack(spark):
    _, docs = _docs(spark)
    assert packing.packed_texts(docs.limit(0), "doc_id", "text", CAPACITIES).count() == 0
    assert packing.packed_texts(docs, "doc_id", "text", {}).count() == 0


def test_token_counts(spark):
    _, docs = _docs(spark)
    got = {r.doc_id: r.tokens for r in token_counts(docs, ["doc_id"], "text").collect()}
    assert got[150] == got[151] == 0 and all(got[i] == len(encode(t)) for i, t in enumerate(_docs(spark)[0]) if t)
