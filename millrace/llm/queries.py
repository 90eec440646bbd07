"""The queries of problems 7 to 9. None of them can be expressed in SQL; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, spam
from millrace.runtime import table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def p7_packed_texts(spark: SparkSession, folder: str) -> DataFrame:
    wanted = packing.capacities(table(spark, folder, "pack_capacities"))
    return packing.packed_texts(table(spark, folder, "documents"), "doc_id", "text", wanted)


@query
def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(p7_packed_texts(spark, folder))


@query
def p8_mixed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


@query
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents"))


@query
def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = spam.score_pages(table(spark, folder, "documents"), "doc_id", "text", "site")
    return scores.select("doc_id", *[F.round(c, 6).alias(c) for c in ("density", "score")])
