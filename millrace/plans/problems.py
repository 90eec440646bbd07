"""The queries of problems 1 to 6 and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import orphans, packed, rolling, sessions, shred, spikes
from millrace.runtime import table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# 1 ----------------------------------------------------------------------------------------------
@query
def p1_readings(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.flag_readings(
        table(spark, folder, "cta_ridership_sample"), "route", "service_date", "rides", "day_type", "ingested_at"
    )


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    bad = p1_readings(spark, folder).where(F.size("reasons") > 0)
    return bad.select(F.col("source").alias("route"), F.date_format("day", "yyyy-MM-dd").alias("service_date"))


# 2 ----------------------------------------------------------------------------------------------
@query
def p2_trailing_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = rolling.trailing_totals(
        table(spark, folder, "cta_ridership_sample"), "route", "service_date", "rides", (7, 30), "ingested_at"
    )
    return totals.withColumnsRenamed({"entity": "route", "day": "service_date"})


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    idle = p2_trailing_totals(spark, folder).where("total_7 = 0 AND total_30 > 0")
    return idle.select("route", F.date_format("service_date", "yyyy-MM-dd").alias("service_date"))


_P2 = """
WITH d AS (SELECT route, service_date, coalesce(arg_max(rides, (ingested_at, rides)), 0) AS rides
           FROM cta_ridership_sample WHERE route IS NOT NULL AND service_date IS NOT NULL GROUP BY ALL),
c AS (SELECT route, CAST(unnest(generate_series(min(service_date), max(service_date), INTERVAL 1 DAY)) AS DATE) AS service_date
      FROM d GROUP BY route),
t AS (SELECT c.route, c.service_date,
        CAST(sum(coalesce(rides, 0)) OVER (w ROWS 6 PRECEDING) AS BIGINT) AS total_7,
        CAST(sum(coalesce(rides, 0)) OVER (w ROWS 29 PRECEDING) AS BIGINT) AS total_30
      FROM c LEFT JOIN d USING (route, service_date) WINDOW w AS (PARTITION BY c.route ORDER BY c.service_date))
"""
SQL["p2_trailing_totals"] = _P2 + "SELECT *, total_7 / 7.0 AS avg_7, total_30 / 30.0 AS avg_30 FROM t"
SQL["p2_found"] = _P2 + "SELECT route, strftime(service_date, '%Y-%m-%d') AS service_date FROM t WHERE total_7 = 0 AND total_30 > 0"


# 3 ----------------------------------------------------------------------------------------------
@query
def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.incremental_sessions(
        table(spark, folder, "events_sample"), "user_id", "event_id", "timestamp", "received_at"
    )


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_sessions(spark, folder).select("user_id", "first_event_id", "last_event_id")


_P3 = """
WITH e AS (SELECT event_id, arg_min(user_id, received_at) AS user_id, arg_min("timestamp", received_at) AS ts
           FROM events_sample WHERE user_id IS NOT NULL AND "timestamp" IS NOT NULL AND event_id IS NOT NULL GROUP BY event_id),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
s AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", arg_min(event_id, (ts, event_id)) AS first_event_id,
        arg_max(event_id, (ts, event_id)) AS last_event_id, count(*) AS events FROM n GROUP BY user_id, session)
"""
SQL["p3_sessions"] = _P3 + """SELECT *, (epoch_us("end") - epoch_us(start)) / 1e6 AS duration_seconds FROM s"""
SQL["p3_found"] = _P3 + "SELECT user_id, first_event_id, last_event_id FROM s"


# 4 ----------------------------------------------------------------------------------------------
@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    names = packed.split_packed(table(spark, folder, "startups_sample"), "id", "investors")
    return names.withColumnRenamed("value", "investor")


# 5 ----------------------------------------------------------------------------------------------
def _references(spark: SparkSession, folder: str) -> list[orphans.Reference]:
    users, products = table(spark, folder, "users_sample"), table(spark, folder, "products_sample")
    return [
        orphans.Reference(
            "orders_sample", table(spark, folder, "orders_sample"), "cart_id", "user_id", "order_date",
            "users_sample", users, "id", "loaded_at", "deleted_at",
        ),
        orphans.Reference(
            "events_sample", table(spark, folder, "events_sample"), "event_id", "product_id", "timestamp",
            "products_sample", products, "id", "loaded_at", "deleted_at",
        ),
    ]


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphans(_references(spark, folder))


@query
def p5_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, folder))


_P5 = """
WITH o AS (
  SELECT 'orders_sample' AS table_name, CAST(cart_id AS VARCHAR) AS row_key, min(strftime(order_date, '%Y-%m')) AS period
  FROM orders_sample c WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users_sample p WHERE p.id = c.user_id
    AND p.loaded_at <= c.order_date AND (p.deleted_at IS NULL OR p.deleted_at > c.order_date)) GROUP BY 1, 2
  UNION ALL
  SELECT 'events_sample', event_id, min(strftime("timestamp", '%Y-%m'))
  FROM events_sample c WHERE product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM products_sample p WHERE p.id = c.product_id
    AND p.loaded_at <= c."timestamp" AND (p.deleted_at IS NULL OR p.deleted_at > c."timestamp")) GROUP BY 1, 2)
"""
SQL["p5_found"] = _P5 + "SELECT table_name, row_key, period FROM o"
SQL["p5_orphan_report"] = _P5 + "SELECT table_name, period, count(*) AS orphan_rows FROM o GROUP BY 1, 2"


# 6 ----------------------------------------------------------------------------------------------
ENTITIES = ("options", "discounts", "tiers", "parts")
# The labels under which clients write a field.
FIELDS = {
    "lines": {"product_id": ("productId", "product_id", "ProductId"), "quantity": ("quantity",), "unit_price": ("unitPrice",), "gift_message": ("gift_message",), "gift_wrap": ("gift_wrap",)},
    "parts": {"product_id": ("productId", "product_id", "ProductId"), "quantity": ("quantity",), "unit_price": ("unitPrice",), "gift_message": ("gift_message",), "gift_wrap": ("gift_wrap",)},
    "options": {"name": ("name",), "value": ("value",), "meta_by": ("meta_by",), "meta_flags": ("meta_flags",)},
    "discounts": {"code": ("code",), "amount": ("amount",)},
    "tiers": {"min": ("min",), "pct": ("pct",)},
}


@query
def p6_nodes(spark: SparkSession, folder: str) -> DataFrame:
    carts = shred.latest(table(spark, folder, "raw_carts"), "id", "ingestion_timestamp", ["products_json"])
    return shred.adjacency(carts, "id", "products_json", ENTITIES).withColumnRenamed("id", "cart_id")


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    records = p6_nodes(spark, folder).where("kind = 'object' AND entity IS NOT NULL")
    return records.select("cart_id", F.col("node").alias("node_path"))


def _entity(name: str):
    def fn(spark: SparkSession, folder: str) -> DataFrame:
        return shred.entity_table(p6_nodes(spark, folder), "cart_id", name, FIELDS[name])

    fn.__name__ = f"p6_{name}"
    return query(fn)


for _name in FIELDS:
    _entity(_name)
