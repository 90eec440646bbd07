from __future__ import annotations

import math
from collections import Counter

import __spark_entry__ as entry
from millrace.functions import text
from millrace.runtime import table
from tests.conftest import rows


def _words(spark, small):
    docs = table(spark, small, "documents")
    return {r.doc_id: r.w or [] for r in docs.select("doc_id", text.words(docs["text"]).alias("w")).collect()}


def test_tf_idf_has_words_and_pairs(spark, small):
    tf = {d: Counter(w + [" ".join(p) for p in zip(w, w[1:])]) for d, w in _words(spark, small).items()}
    df, n = Counter(t for c in tf.values() for t in c), Counter()
    for c in tf.values():
        n.update(c)
    kept = set(sorted((t for t in df if df[t] >= 2), key=lambda t: (-n[t], t))[:5000])
    want = {}
    for d, c in tf.items():
        x = {t: (1 + math.log(k)) * (1 + math.log((1 + len(tf)) / (1 + df[t]))) for t, k in c.items() if t in kept}
        length = math.sqrt(sum(v * v for v in x.values()))
        want |= {(d, t): v / length for t, v in x.items()}
    got = {(r.doc_id, r.term): r.weight for r in entry.queries()["tf_idf_terms"](spark, small).collect()}
    assert got.keys() == want.keys() and any(" " in t for _, t in got)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_searches_ask_every_fiftieth_document(spark, small):
    asked = {d for d, w in _words(spark, small).items() if d % 50 == 0 and w}
    found = entry.queries()["bm25_documents"](spark, small).collect()
    assert asked and {r.query_id for r in found} == asked
    fused = entry.queries()["rrf_fusion"](spark, small).collect()
    assert {r.query_id for r in fused} == asked
    for q in asked:
        assert any(r.query_id == q and r.doc_id == q for r in fused)


def test_fusion_shuffles_the_best_hits_only(spark):
    from tests.test_added_operators import _most_shuffled

    found = entry.queries()["rrf_fusion"](spark, "/root/testdata/sf0.01")  # 20 questions of 1,000 documents
    assert {r.position for r in found.collect()} == set(range(1, 11))
    assert _most_shuffled(found) < 20 * 1000 / 3


def test_fusion_shuffles_no_more_for_more_files(spark, tmp_path):
    from tests.test_added_operators import _most_shuffled

    one = "/root/testdata/sf0.01"  # 20 questions of 1,000 documents
    want = rows(entry.queries()["rrf_fusion"](spark, one))
    table(spark, one, "documents").repartition(64).write.parquet(f"{tmp_path}/documents.parquet")
    with_files = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(with_files, "4096")  # a task for every file, of which each has fewer documents than are asked for
    try:
        found = entry.queries()["rrf_fusion"](spark, str(tmp_path))
        assert rows(found) == want
        assert _most_shuffled(found) < 20 * 1000 / 3
    finally:
        spark.conf.unset(with_files)
