"""Star-schema reports: revenue, growth, shares, freight, payments, delivery, tops and bottoms.

Status F stands for delivered, extended price times tax for freight, order priority for the means
of payment, part type for the category, and delivery days are derived from the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import month
from millrace.functions.numbers import buckets, money, ratio
from millrace.operators import reports as R
from millrace.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# The categories that have a translation; the others keep their raw name.
TRANSLATED = {"STANDARD": "standard goods", "SMALL": "small goods", "PROMO": "promotions"}

def price():
    return money("l_extendedprice", 12, 2)


def freight():
    return price() * money("l_tax", 4, 2)


def revenue():
    return F.sum(price()).cast("double")


def _delivered(spark, folder):
    return table(spark, folder, "orders").where("o_orderstatus = 'F'")


def _items(spark, folder) -> DataFrame:
    return _delivered(spark, folder).join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))


def _with_region(df, spark, folder):
    return (
        df.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def _with_category(df, spark, folder):
    """Category of the part, through a translation that lacks some names (left lookup with fallbacks)."""
    names = spark.createDataFrame(list(TRANSLATED.items()), "p_type string, label string")
    parts = table(spark, folder, "part").select("p_partkey", "p_type").join(F.broadcast(names), "p_type", "left")
    named = parts.select("p_partkey", F.coalesce("label", "p_type", F.lit("unknown_category")).alias("category"))
    return df.join(named, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn(
        "category", F.coalesce("category", F.lit("unknown_category"))
    )


S_ITEMS = "orders JOIN lineitem ON o_orderkey = l_orderkey"
S_REGION = " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
S_CATEGORY = """ LEFT JOIN (SELECT p_partkey, coalesce(label, p_type, 'unknown_category') AS category FROM part
  LEFT JOIN (VALUES ('STANDARD', 'standard goods'), ('SMALL', 'small goods'), ('PROMO', 'promotions')) t(k, label) ON p_type = k) c
  ON l_partkey = p_partkey"""
S_PRICE = "CAST(l_extendedprice AS DECIMAL(12, 2))"
S_FREIGHT = f"{S_PRICE} * CAST(l_tax AS DECIMAL(4, 2))"
S_REVENUE = f"CAST(sum({S_PRICE}) AS DOUBLE)"


@query(f"""SELECT {S_REVENUE} AS revenue, count(DISTINCT o_orderkey) AS orders, {S_REVENUE} / count(DISTINCT o_orderkey) AS average_order
  FROM {S_ITEMS} WHERE o_orderstatus = 'F'""")
def revenue_kpis(spark: SparkSession, folder: str) -> DataFrame:
    one = R.totals(_items(spark, folder), {"revenue": revenue(), "orders": F.count_distinct("o_orderkey")})
    return one.withColumn("average_order", ratio(F.col("revenue"), F.col("orders")))


def _monthly(spark, folder):
    by_month = _items(spark, folder).where("o_orderdate >= '1996-01-01'").withColumn("month", month(F.col("o_orderdate")))
    return R.totals(by_month, {"revenue": revenue(), "orders": F.count_distinct("o_orderkey")}, ["month"])


S_MONTHLY = f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {S_REVENUE} AS revenue, count(DISTINCT o_orderkey) AS orders
  FROM {S_ITEMS} WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1"""


@query(f"SELECT *, 100.0 * (revenue - lag(revenue) OVER (ORDER BY month)) / nullif(lag(revenue) OVER (ORDER BY month), 0) AS growth FROM ({S_MONTHLY})")
def monthly_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return R.growth(_monthly(spark, folder), "month", "revenue", 1, "growth")


@query(f"SELECT *, 100.0 * (revenue - lag(revenue, 12) OVER (ORDER BY month)) / nullif(lag(revenue, 12) OVER (ORDER BY month), 0) AS growth FROM ({S_MONTHLY})")
def yoy_growth(spark: SparkSession, folder: str) -> DataFrame:
    return R.growth(_monthly(spark, folder), "month", "revenue", 12, "growth")


@query(f"""WITH m AS ({S_MONTHLY}) SELECT a.*, 100.0 * (a.revenue - b.revenue) / nullif(b.revenue, 0) AS growth
  FROM m a LEFT JOIN m b ON CAST(b.month + INTERVAL 12 MONTH AS DATE) = a.month""")
def yoy_growth_gap_safe(spark: SparkSession, folder: str) -> DataFrame:
    return R.growth_by_month(_monthly(spark, folder), "month", "revenue", 12, "growth")


@query(f"""SELECT r_name AS region, {S_REVENUE} AS revenue, count(DISTINCT o_orderkey) AS orders,
  100.0 * {S_REVENUE} / sum({S_REVENUE}) OVER () AS share FROM {S_ITEMS}{S_REGION} WHERE o_orderstatus = 'F' GROUP BY r_name""")
def revenue_by_region(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_region(_items(spark, folder), spark, folder).withColumnRenamed("r_name", "region")
    return R.with_share(R.totals(rows, {"revenue": revenue(), "orders": F.count_distinct("o_orderkey")}, ["region"]), "revenue", "share")


@query(f"""SELECT category, {S_REVENUE} AS revenue, count(*) AS items, 100.0 * {S_REVENUE} / sum({S_REVENUE}) OVER () AS share
  FROM {S_ITEMS}{S_CATEGORY} WHERE o_orderstatus = 'F' GROUP BY category""")
def revenue_by_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_category(_items(spark, folder), spark, folder)
    return R.with_share(R.totals(rows, {"revenue": revenue(), "items": F.count(F.lit(1))}, ["category"]), "revenue", "share")


@query(f"""SELECT r_name AS region, category, {S_REVENUE} AS revenue, 100.0 * {S_REVENUE} / sum({S_REVENUE}) OVER (PARTITION BY r_name) AS share
  FROM {S_ITEMS}{S_REGION}{S_CATEGORY} WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def region_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_category(_with_region(_items(spark, folder), spark, folder), spark, folder).withColumnRenamed("r_name", "region")
    return R.with_share(R.totals(rows, {"revenue": revenue()}, ["region", "category"]), "revenue", "share", ["region"])


def _freight(rows, by, least=1):
    out = R.ratio_of_sums(rows, by, freight(), price(), F.count_distinct("o_orderkey"), least)
    return out.select(*by, F.col("numerator").cast("double").alias("freight"), F.col("denominator").cast("double").alias("revenue"), F.col("n").alias("orders"), "pct")


def _s_freight(by: str, joins: str, least: int = 1) -> str:
    return f"""SELECT {by}, CAST(sum({S_FREIGHT}) AS DOUBLE) AS freight, {S_REVENUE} AS revenue, count(DISTINCT o_orderkey) AS orders,
      100.0 * (CAST(sum({S_FREIGHT}) AS DOUBLE) / nullif({S_REVENUE}, 0)) AS pct
      FROM {S_ITEMS}{joins} WHERE o_orderstatus = 'F' GROUP BY ALL HAVING count(DISTINCT o_orderkey) >= {least}"""


@query(_s_freight("category", S_CATEGORY, 30))
def freight_ratio_category(spark: SparkSession, folder: str) -> DataFrame:
    return _freight(_with_category(_items(spark, folder), spark, folder), ["category"], 30)


@query(_s_freight("r_name AS region", S_REGION))
def freight_ratio_region(spark: SparkSession, folder: str) -> DataFrame:
    return _freight(_with_region(_items(spark, folder), spark, folder).withColumnRenamed("r_name", "region"), ["region"])


@query(_s_freight("n_name AS nation, category", S_REGION + S_CATEGORY, 20) + " ORDER BY pct DESC, nation, category LIMIT 25")
def freight_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_category(_with_region(_items(spark, folder), spark, folder), spark, folder).withColumnRenamed("n_name", "nation")
    return R.top(_freight(rows, ["nation", "category"], 20), 25, [F.desc("pct"), F.asc("nation"), F.asc("category")])


S_VALUE = "CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) AS DOUBLE)"


@query(f"""SELECT o_orderpriority AS payment, count(DISTINCT o_orderkey) AS orders, {S_VALUE} AS value, {S_VALUE} / count(*) AS mean_value,
  100.0 * count(DISTINCT o_orderkey) / sum(count(DISTINCT o_orderkey)) OVER () AS order_share,
  100.0 * ({S_VALUE} / sum({S_VALUE}) OVER ()) AS value_share FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def payment_mix(spark: SparkSession, folder: str) -> DataFrame:
    value = F.sum(money("o_totalprice", 14, 2)).cast("double")
    rows = _delivered(spark, folder).withColumnRenamed("o_orderpriority", "payment")
    out = R.totals(rows, {"orders": F.count_distinct("o_orderkey"), "value": value, "n": F.count(F.lit(1))}, ["payment"])
    out = out.withColumn("mean_value", ratio(F.col("value"), F.col("n"))).drop("n")
    return R.with_share(R.with_share(out, "orders", "order_share"), "value", "value_share")


@query(f"SELECT 1 + o_orderkey % 12 AS installments, count(*) AS payments, {S_VALUE} / count(*) AS mean_value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def installments(spark: SparkSession, folder: str) -> DataFrame:
    rows = _delivered(spark, folder).withColumn("installments", 1 + F.col("o_orderkey") % 12)
    value = F.sum(money("o_totalprice", 14, 2)).cast("double")
    return R.totals(rows, {"payments": F.count(F.lit(1)), "value": value}, ["installments"]).select(
        "installments", "payments", ratio(F.col("value"), F.col("payments")).alias("mean_value")
    )


EDGES, LABELS = (50_000, 100_000, 200_000), ("under 50k", "50k to 100k", "100k to 200k", "200k and more")


@query(f"""SELECT CASE WHEN o_totalprice < 50000 THEN 'under 50k' WHEN o_totalprice < 100000 THEN '50k to 100k'
  WHEN o_totalprice < 200000 THEN '100k to 200k' ELSE '200k and more' END AS bucket, count(*) AS orders, {S_VALUE} AS value
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def value_buckets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _delivered(spark, folder).withColumn("bucket", buckets(F.col("o_totalprice"), EDGES, LABELS))
    return R.totals(rows, {"orders": F.count(F.lit(1)), "value": F.sum(money("o_totalprice", 14, 2)).cast("double")}, ["bucket"])


# Delivery: estimated 20 days after the order, delivered after 10 to 40 days, NULL (unknown) for some orders, which count as not late.
def _delivery(spark, folder):
    days = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey") % 31 - 10)
    return _delivered(spark, folder).withColumn("days_late", days).withColumn("score", 1 + F.col("o_orderkey") % 5)


S_DELIVERY = "(SELECT *, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey % 31 - 10 END AS days_late, 1 + o_orderkey % 5 AS score FROM orders WHERE o_orderstatus = 'F')"


@query(f"SELECT o_orderkey, days_late FROM {S_DELIVERY} WHERE days_late > 0 ORDER BY days_late DESC, o_orderkey LIMIT 100")
def late_orders_top(spark: SparkSession, folder: str) -> DataFrame:
    late = _delivery(spark, folder).where("days_late > 0").select("o_orderkey", "days_late")
    return R.top(late, 100, [F.desc("days_late"), F.asc("o_orderkey")])


@query(f"""SELECT CASE WHEN days_late <= 0 THEN 'on time' WHEN days_late <= 3 THEN '1-3 days' WHEN days_late <= 7 THEN '4-7 days'
  WHEN days_late <= 14 THEN '8-14 days' WHEN days_late > 14 THEN '15 days and more' ELSE 'unknown' END AS bucket, count(*) AS orders, CAST(sum(score) AS DOUBLE) / count(*) AS mean_score
  FROM {S_DELIVERY} GROUP BY 1""")
def delay_buckets(spark: SparkSession, folder: str) -> DataFrame:
    label = buckets(F.col("days_late"), (0, 3, 7, 14), ("on time", "1-3 days", "4-7 days", "8-14 days", "15 days and more"), right=True, missing="unknown")
    return R.totals(_delivery(spark, folder).withColumn("bucket", label), {"orders": F.count(F.lit(1)), "mean_score": F.avg("score")}, ["bucket"])


@query(f"""SELECT n_name AS nation, count(*) AS n, CAST(sum(CASE WHEN days_late > 0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  100.0 * (sum(CASE WHEN days_late > 0 THEN 1 ELSE 0 END) / count(*)) AS pct FROM {S_DELIVERY} JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 30""")
def late_rate_nation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_region(_delivery(spark, folder), spark, folder).withColumnRenamed("n_name", "nation")
    return R.rate(rows, ["nation"], F.col("days_late") > 0, 30)


@query(f"""SELECT l_suppkey AS seller, count(DISTINCT o_orderkey) AS orders, count(*) AS n, CAST(sum(CASE WHEN days_late > 0 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  100.0 * (sum(CASE WHEN days_late > 0 THEN 1 ELSE 0 END) / count(*)) AS pct
  FROM {S_DELIVERY} JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 30 ORDER BY pct DESC, seller LIMIT 25""")
def late_rate_seller(spark: SparkSession, folder: str) -> DataFrame:
    rows = _delivery(spark, folder).join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = rows.groupBy(F.col("l_suppkey").alias("seller")).agg(
        F.count_distinct("o_orderkey").alias("orders"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("days_late") > 0).alias("flagged")
    )
    out = out.where("orders >= 30").withColumn("pct", 100.0 * ratio(F.col("flagged"), F.col("n")))
    return R.top(out, 25, [F.desc("pct"), F.asc("seller")])


def _ranked(rows, key, least=1):
    out = R.totals(rows, {"revenue": revenue(), "orders": F.count_distinct("o_orderkey"), "freight": F.sum(freight()).cast("double")}, [key])
    return out.where(F.col("orders") >= least).withColumn("margin_proxy", 100.0 - 100.0 * ratio(F.col("freight"), F.col("revenue")))


def _s_ranked(key: str, joins: str, least: int = 1) -> str:
    return f"""SELECT {key}, {S_REVENUE} AS revenue, count(DISTINCT o_orderkey) AS orders, CAST(sum({S_FREIGHT}) AS DOUBLE) AS freight,
      100.0 - 100.0 * (CAST(sum({S_FREIGHT}) AS DOUBLE) / {S_REVENUE}) AS margin_proxy
      FROM {S_ITEMS}{joins} WHERE o_orderstatus = 'F' GROUP BY ALL HAVING count(DISTINCT o_orderkey) >= {least}"""


@query(_s_ranked("p_brand AS brand", " JOIN part ON l_partkey = p_partkey") + " ORDER BY revenue DESC, brand LIMIT 10")
def top_brands(spark: SparkSession, folder: str) -> DataFrame:
    rows = _items(spark, folder).join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_brand", "brand")
    return R.top(_ranked(rows, "brand"), 10, [F.desc("revenue"), F.asc("brand")])


@query(_s_ranked("p_brand AS brand", " JOIN part ON l_partkey = p_partkey", 30) + " ORDER BY revenue, brand LIMIT 10")
def bottom_brands(spark: SparkSession, folder: str) -> DataFrame:
    rows = _items(spark, folder).join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_brand", "brand")
    return R.top(_ranked(rows, "brand", 30), 10, [F.asc("revenue"), F.asc("brand")])


@query(f"""WITH r AS ({_s_ranked("l_suppkey AS seller", "", 30)})
  (SELECT *, 'top' AS "end" FROM r ORDER BY margin_proxy DESC, seller LIMIT 10) UNION ALL
  (SELECT *, 'bottom' AS "end" FROM r ORDER BY margin_proxy, seller LIMIT 10)""")
def margin_top_bottom(spark: SparkSession, folder: str) -> DataFrame:
    return R.top_and_bottom(_ranked(_items(spark, folder).withColumnRenamed("l_suppkey", "seller"), "seller", 30), 10, "margin_proxy", "seller")


@query(_s_ranked("l_suppkey AS seller", "") + " ORDER BY revenue DESC, seller LIMIT 10")
def top_sellers(spark: SparkSession, folder: str) -> DataFrame:
    return R.top(_ranked(_items(spark, folder).withColumnRenamed("l_suppkey", "seller"), "seller"), 10, [F.desc("revenue"), F.asc("seller")])


@query("""SELECT dow, CAST(sum(CASE WHEN p = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, CAST(sum(CASE WHEN p = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high,
  CAST(sum(CASE WHEN p = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM (SELECT isodow(o_orderdate) - 1 AS dow, o_orderpriority AS p FROM orders) GROUP BY dow""")
def dow_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.weekday("o_orderdate").alias("dow"), "o_orderpriority")
    wide = R.pivot(rows, ["dow"], "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], F.count(F.lit(1)))
    return wide.na.fill(0).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"})


@query("SELECT event_type, count(*) AS n, 100.0 * (count(*) / sum(count(*)) OVER ()) AS pct FROM events GROUP BY 1")
def event_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.value_counts(table(spark, folder, "events"), "event_type")


_PROFILED = ["user_id", "session_id", "channel", "product_id", "event_type"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, 100.0 * ((count(*) - count({c})) / count(*)) AS null_pct,
    count(DISTINCT {c}) AS distinct_values FROM events_sample""" for c in _PROFILED))
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return R.profile(table(spark, folder, "events_sample"), _PROFILED)


@query("""SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS surplus
  FROM (SELECT count(*) AS n FROM startups_sample GROUP BY id, name, description, sector, stage, funding_amount_usd, funding_year,
  hq_country, hq_city, founded_year, employee_count, revenue_stage, investors, traction_signal)""")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return R.duplicate_rows(table(spark, folder, "startups_sample"))


@query("""SELECT * EXCLUDE rn, rn AS position FROM (SELECT n_name AS nation, c_custkey AS customer, c_acctbal AS balance, row_number() OVER (PARTITION BY n_name
  ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rn <= 3""")
def top_customers_per_nation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("nation"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance"))
    return R.top_per_group(rows, ["nation"], [F.desc("balance"), F.asc("customer")], 3)
