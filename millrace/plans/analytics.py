"""Customers, sessions, cohorts, experiments, funding marts, series, data quality, scores, text and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import dates, ids, numbers, text, vectors
from millrace.functions.numbers import money, ratio
from millrace.operators import quality as Q
from millrace.operators import reports as R
from millrace.operators import learning, retrieval, series, sessions, stats, upsert
from millrace.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


S_TOTAL = "CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) AS DOUBLE)"
AS_OF = "2001-09-01"


def total():
    return F.sum(money("o_totalprice", 14, 2)).cast("double")


# Latest rows and merging ------------------------------------------------------------------------
@query("""SELECT * EXCLUDE rn FROM (SELECT id, username, email, loaded_at, deleted_at, row_number() OVER (PARTITION BY id
  ORDER BY loaded_at DESC, username DESC NULLS LAST, email DESC NULLS LAST, deleted_at DESC NULLS LAST) AS rn FROM users_sample) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.latest_per_key(table(spark, folder, "users_sample"), ["id"], ["loaded_at"])


@query("""SELECT * EXCLUDE rn FROM (SELECT route, service_date, rides, row_number() OVER (PARTITION BY route ORDER BY service_date, ingested_at, rides NULLS FIRST) AS rn
  FROM cta_ridership_sample) WHERE rn = 1""")
def first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cta_ridership_sample").select("route", "service_date", "ingested_at", "rides")
    return upsert.latest_per_key(rows, ["route"], ["service_date", "ingested_at"], first=True).drop("ingested_at")


def _corrections(spark, folder):
    """Later versions of some orders and some new ones."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    later = o.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("C"))
    return later.unionByName(o.where("o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0").withColumn("o_orderkey", -F.col("o_orderkey")))


S_CORRECTIONS = """(SELECT o_orderkey, 'C' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0)"""


@query(f"""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {S_CORRECTIONS})
  UNION ALL SELECT * FROM {S_CORRECTIONS}""")
def upsert_orders(spark: SparkSession, folder: str) -> DataFrame:
    target = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return upsert.merge(target, _corrections(spark, folder), ["o_orderkey"])


@query(f"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN o.o_orderstatus = c.o_orderstatus THEN 'same' ELSE 'update' END AS action
  FROM {S_CORRECTIONS} c LEFT JOIN orders o ON o.o_orderkey = c.o_orderkey) GROUP BY 1""")
def upsert_actions(spark: SparkSession, folder: str) -> DataFrame:
    target = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    found = upsert.changes(target, _corrections(spark, folder), ["o_orderkey"], ["o_orderstatus"])
    return found.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT DISTINCT c_nationkey + 20, 'unknown' FROM customer WHERE c_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def complete_lookup(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "customer").select((F.col("c_nationkey") + 20).alias("n_nationkey"), F.lit("unknown").alias("n_name"))
    return upsert.add_missing(table(spark, folder, "nation").select("n_nationkey", "n_name"), used, ["n_nationkey"])


@query("SELECT DISTINCT user_id AS value FROM orders_sample WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users_sample)")
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.missing_keys(table(spark, folder, "orders_sample"), "user_id", table(spark, folder, "users_sample"), "id")


@query("SELECT o_orderkey AS value FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_items(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.missing_keys(table(spark, folder, "orders"), "o_orderkey", table(spark, folder, "lineitem"), "l_orderkey")


# Customers --------------------------------------------------------------------------------------
@query("""SELECT l_orderkey AS order_key, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS units,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) AS amount, count(DISTINCT l_partkey) AS products FROM lineitem GROUP BY 1""")
def order_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(money("l_quantity", 12, 2)).cast("double").alias("units"),
        F.sum(money("l_extendedprice", 12, 2)).cast("double").alias("amount"), F.count_distinct("l_partkey").alias("products"),
    )


@query(f"""WITH b AS (SELECT o_custkey AS customer, count(*) AS orders, {S_TOTAL} AS spend, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
    FROM orders GROUP BY 1),
  f AS (SELECT o_custkey AS customer, p_type AS favourite, row_number() OVER (PARTITION BY o_custkey
    ORDER BY sum(CAST(l_extendedprice AS DECIMAL(12, 2))) DESC, p_type) AS rn FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
  SELECT b.customer, orders, spend, spend / orders AS mean_order, date_diff('day', CAST(first_order AS DATE), CAST(last_order AS DATE)) AS lifespan_days,
    date_diff('day', CAST(last_order AS DATE), DATE '{AS_OF}') AS idle_days, date_diff('month', first_order, last_order) AS months,
    CASE WHEN date_diff('day', CAST(first_order AS DATE), CAST(last_order AS DATE)) > 30 THEN orders / (date_diff('day', CAST(first_order AS DATE), CAST(last_order AS DATE)) / 30.0) ELSE 1.0 END AS orders_a_month,
    favourite FROM b LEFT JOIN f ON b.customer = f.customer AND rn = 1""")
def customer_kpis(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    base = orders.groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count(F.lit(1)).alias("orders"), total().alias("spend"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")
    )
    lines = orders.join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    spent = lines.groupBy(F.col("o_custkey").alias("customer"), "p_type").agg(F.sum(money("l_extendedprice", 12, 2)).alias("s"))
    liked = spent.groupBy("customer").agg(F.min_by("p_type", F.struct(-F.col("s"), F.col("p_type"))).alias("favourite"))
    life = F.datediff(F.col("b").cast("date"), F.col("a").cast("date"))
    return base.join(liked, "customer", "left").select(
        "customer", "orders", "spend", ratio(F.col("spend"), F.col("orders")).alias("mean_order"), life.alias("lifespan_days"),
        F.datediff(F.lit(AS_OF).cast("date"), F.col("b").cast("date")).alias("idle_days"),
        dates.months_between_starts(F.col("b"), F.col("a")).alias("months"),
        F.when(life > 30, F.col("orders") / (life / F.lit(30.0))).otherwise(1.0).alias("orders_a_month"), "favourite",
    )


@query("""SELECT p_partkey AS part, p_type AS type, count(l_orderkey) AS sales, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(12, 2))), 0) AS DOUBLE) AS revenue,
  count(DISTINCT l_orderkey) AS orders FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2""")
def product_metrics(spark: SparkSession, folder: str) -> DataFrame:
    sold = table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("sales"), F.sum(money("l_extendedprice", 12, 2)).cast("double").alias("revenue"), F.count_distinct("l_orderkey").alias("orders")
    )
    parts = table(spark, folder, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    return parts.select(F.col("p_partkey").alias("part"), F.col("p_type").alias("type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sales", "revenue", "orders")])


S_GAPS = """(SELECT user_id, ts, event_type, value, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS o FROM events))"""
STEPS = ("view", "click", "signup", "purchase")
S_SESSIONS = f"""SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS events, count(DISTINCT event_type) AS types,
  {", ".join(f"bool_or(event_type = '{s}') AS has_{s}" for s in STEPS)} FROM {S_GAPS} GROUP BY user_id, s"""


def _user_sessions(spark, folder):
    e = table(spark, folder, "events")
    return sessions.with_session_start(e, "user_id", "ts", 12 * 3600).groupBy("user_id", "session").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"), F.count_distinct("event_type").alias("types"),
        *[F.bool_or(F.col("event_type") == s).alias(f"has_{s}") for s in STEPS],
    ).drop("session")


@query(S_SESSIONS)
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _user_sessions(spark, folder)


S_FURTHEST = "CASE WHEN has_purchase THEN 'purchase' WHEN has_signup THEN 'signup' WHEN has_click THEN 'click' WHEN has_view THEN 'view' ELSE 'none' END"


@query(f"SELECT {S_FURTHEST} AS furthest, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, 100.0 * (count(*) / sum(count(*)) OVER ()) AS pct FROM ({S_SESSIONS}) GROUP BY 1")
def furthest_step(spark: SparkSession, folder: str) -> DataFrame:
    last = F.when(F.col("has_purchase"), "purchase").when(F.col("has_signup"), "signup").when(F.col("has_click"), "click").when(F.col("has_view"), "view").otherwise("none")
    out = _user_sessions(spark, folder).groupBy(last.alias("furthest")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"))
    return R.with_share(out, "sessions", "pct")


@query(f"""WITH s AS ({S_SESSIONS}), f AS ({" UNION ALL ".join(f"SELECT {i} AS step, '{x}' AS name, count(*) FILTER (has_{x}) AS sessions FROM s" for i, x in enumerate(STEPS))})
  SELECT *, 100.0 * (sessions / nullif(lag(sessions) OVER (ORDER BY step), 0)) AS step_rate FROM f""")
def funnel(spark: SparkSession, folder: str) -> DataFrame:
    one = _user_sessions(spark, folder).agg(*[F.count_if(f"has_{s}").alias(s) for s in STEPS])
    rows = one.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("sessions")) for s in STEPS])).alias("step", "x")).select("step", "x.*")
    return rows.withColumn("step_rate", 100.0 * ratio(F.col("sessions"), F.lag("sessions").over(Window.orderBy("step"))))


@query(f"""SELECT user_id, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, min(start) AS first_seen, max("end") AS last_seen,
  count(*) FILTER (has_purchase) AS converted, 100.0 * (count(*) FILTER (has_purchase) / count(*)) AS conversion FROM ({S_SESSIONS}) GROUP BY 1""")
def customer_journey(spark: SparkSession, folder: str) -> DataFrame:
    out = _user_sessions(spark, folder).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.min("start").alias("first_seen"), F.max("end").alias("last_seen"), F.count_if("has_purchase").alias("converted")
    )
    return out.withColumn("conversion", 100.0 * ratio(F.col("converted"), F.col("sessions")))


S_COHORT = """WITH c AS (SELECT o_custkey AS u, o_orderdate AS t, CAST(date_trunc('quarter', min(o_orderdate) OVER (PARTITION BY o_custkey)) AS DATE) AS cohort,
    CAST(o_totalprice AS DECIMAL(14, 2)) AS p FROM orders WHERE o_orderstatus = 'F'),
  p AS (SELECT cohort, (year(t) * 4 + quarter(t)) - (year(cohort) * 4 + quarter(cohort)) AS period, count(DISTINCT u) AS users, CAST(sum(p) AS DOUBLE) AS revenue FROM c GROUP BY 1, 2)"""


def _cohorts(spark, folder):
    rows = table(spark, folder, "orders").where("o_orderstatus = 'F'")
    firsts = rows.groupBy("o_custkey").agg(F.trunc(F.min("o_orderdate").cast("date"), "QUARTER").alias("cohort"))
    q = lambda c: F.year(c) * 4 + F.quarter(c)
    joined = rows.join(firsts, "o_custkey").withColumn("period", q("o_orderdate") - q("cohort"))
    return joined.groupBy("cohort", "period").agg(F.count_distinct("o_custkey").alias("users"), total().alias("revenue"))


@query(S_COHORT + "SELECT p.cohort, period, users, size, 100.0 * (users / size) AS rate FROM p JOIN (SELECT cohort, users AS size FROM p WHERE period = 0) USING (cohort)")
def retention_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    c = _cohorts(spark, folder)
    size = c.where("period = 0").select("cohort", F.col("users").alias("size"))
    return c.drop("revenue").join(size, "cohort").withColumn("rate", 100.0 * ratio(F.col("users"), F.col("size")))


@query(S_COHORT + f"""SELECT cohort, {", ".join(f"max(CASE WHEN period = {i} THEN users END) AS p{i}" for i in range(4))} FROM p GROUP BY 1""")
def retention_grid(spark: SparkSession, folder: str) -> DataFrame:
    wide = R.pivot(_cohorts(spark, folder), ["cohort"], "period", [0, 1, 2, 3], F.max("users"))
    return wide.withColumnsRenamed({str(i): f"p{i}" for i in range(4)})


@query(S_COHORT + "SELECT cohort, period, revenue, sum(revenue) OVER (PARTITION BY cohort ORDER BY period) AS so_far FROM p")
def cohort_revenue(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("cohort").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return _cohorts(spark, folder).drop("users").withColumn("so_far", F.sum("revenue").over(w))


# Experiments ------------------------------------------------------------------------------------
S_VARIANT = f"""SELECT *, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, user_id % 3 AS device FROM ({S_SESSIONS})"""


def _variant_sessions(spark, folder):
    s = _user_sessions(spark, folder)
    return s.withColumn("variant", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")).withColumn("device", F.col("user_id") % 3)


@query(f"""SELECT variant, count(*) AS sessions, count(*) FILTER (has_purchase) AS converted, 100.0 * (count(*) FILTER (has_purchase) / count(*)) AS rate,
  100.0 * (count(*) FILTER (has_click) / count(*)) AS click_rate, min(start) AS first_seen FROM ({S_VARIANT}) GROUP BY 1""")
def ab_results(spark: SparkSession, folder: str) -> DataFrame:
    out = _variant_sessions(spark, folder).groupBy("variant").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("has_purchase").alias("converted"), F.count_if("has_click").alias("c"), F.min("start").alias("first_seen")
    )
    return out.withColumn("rate", 100.0 * ratio(F.col("converted"), F.col("sessions"))).withColumn("click_rate", 100.0 * ratio(F.col("c"), F.col("sessions"))).drop("c")


@query(f"""WITH g AS (SELECT device, variant, count(*) AS n, count(*) FILTER (has_purchase) / count(*) AS r FROM ({S_VARIANT}) GROUP BY 1, 2)
  SELECT device, max(CASE WHEN variant = 'A' THEN r END) AS rate_a, max(CASE WHEN variant = 'B' THEN r END) AS rate_b,
  max(CASE WHEN variant = 'B' THEN r END) - max(CASE WHEN variant = 'A' THEN r END) AS lift FROM g GROUP BY 1""")
def ab_segments(spark: SparkSession, folder: str) -> DataFrame:
    converted = F.avg(F.col("has_purchase").cast("int"))
    wide = R.pivot(_variant_sessions(spark, folder), ["device"], "variant", ["A", "B"], converted).withColumnsRenamed({"A": "rate_a", "B": "rate_b"})
    return wide.withColumn("lift", F.col("rate_b") - F.col("rate_a"))


@query(f"""WITH g AS (SELECT count(*) FILTER (variant = 'A') AS na, count(*) FILTER (variant = 'B') AS nb, count(*) FILTER (variant = 'A' AND has_purchase) AS xa,
  count(*) FILTER (variant = 'B' AND has_purchase) AS xb FROM ({S_VARIANT}))
  SELECT xa / na AS rate_a, xb / nb AS rate_b, xb / nb - xa / na AS lift,
  (xb / nb - xa / na) / sqrt((xa + xb) / (na + nb) * (1 - (xa + xb) / (na + nb)) * (1.0 / na + 1.0 / nb)) AS z FROM g""")
def ab_ztest(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("variant") == "A", F.col("variant") == "B"
    g = _variant_sessions(spark, folder).agg(
        F.count_if(a).alias("na"), F.count_if(b).alias("nb"), F.count_if(a & F.col("has_purchase")).alias("xa"), F.count_if(b & F.col("has_purchase")).alias("xb")
    )
    pa, pb, p = F.col("xa") / F.col("na"), F.col("xb") / F.col("nb"), (F.col("xa") + F.col("xb")) / (F.col("na") + F.col("nb"))
    se = F.sqrt(p * (1 - p) * (1.0 / F.col("na") + 1.0 / F.col("nb")))
    return g.select(pa.alias("rate_a"), pb.alias("rate_b"), (pb - pa).alias("lift"), F.try_divide(pb - pa, se).alias("z"))


@query(f"""SELECT variant, CASE WHEN start < TIMESTAMP '2024-01-08' THEN 'first week' ELSE 'later' END AS phase, count(*) AS sessions,
  100.0 * (count(*) FILTER (has_purchase) / count(*)) AS rate FROM ({S_VARIANT}) GROUP BY 1, 2""")
def novelty_effect(spark: SparkSession, folder: str) -> DataFrame:
    phase = F.when(F.col("start") < F.lit("2024-01-08").cast("timestamp_ntz"), "first week").otherwise("later")
    out = _variant_sessions(spark, folder).groupBy("variant", phase.alias("phase")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if("has_purchase").alias("c"))
    return out.select("variant", "phase", "sessions", (100.0 * ratio(F.col("c"), F.col("sessions"))).alias("rate"))


# Funding marts ----------------------------------------------------------------------------------
S_FUNDED = """(SELECT lower(trim(sector)) AS sector, lower(trim(stage)) AS stage, funding_year AS year, funding_amount_usd AS amount, hq_country AS country
  FROM (SELECT DISTINCT id, sector, stage, funding_year, funding_amount_usd, hq_country FROM startups_sample) WHERE funding_amount_usd > 0 AND sector IS NOT NULL AND funding_year IS NOT NULL)"""


def _funded(spark, folder):
    rows = table(spark, folder, "startups_sample").select("id", "sector", "stage", "funding_year", "funding_amount_usd", "hq_country").distinct()
    return rows.where("funding_amount_usd > 0 AND sector IS NOT NULL AND funding_year IS NOT NULL").select(
        F.lower(F.trim("sector")).alias("sector"), F.lower(F.trim("stage")).alias("stage"), F.col("funding_year").alias("year"), F.col("funding_amount_usd").alias("amount"), F.col("hq_country").alias("country")
    )


S_MEASURES = "count(*) AS rounds, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total, median(amount) AS median_amount, min(amount) AS least, max(amount) AS most, count_if(amount >= 10000000) AS large"


def _measures():
    return [
        F.count(F.lit(1)).alias("rounds"), F.sum(money("amount")).cast("double").alias("total"),
        F.min("amount").alias("least"), F.max("amount").alias("most"), F.count_if(F.col("amount") >= 10_000_000).alias("large"),
    ]


@query(f"""WITH t AS (SELECT sector, year, {S_MEASURES} FROM {S_FUNDED} GROUP BY 1, 2)
  SELECT *, 100.0 * ((total - lag(total) OVER w) / nullif(lag(total) OVER w, 0)) AS growth FROM t WINDOW w AS (PARTITION BY sector ORDER BY year)""")
def funding_trends(spark: SparkSession, folder: str) -> DataFrame:
    rows = _funded(spark, folder)
    middle = stats.percentiles(rows, ["sector", "year"], "amount", [0.5]).select("sector", "year", F.col("percentiles")[0].alias("median_amount"))
    return R.growth(rows.groupBy("sector", "year").agg(*_measures()).join(middle, ["sector", "year"]), "year", "total", 1, "growth", ["sector"])


@query(f"""WITH f AS (SELECT sector, stage, country, count(*) AS rounds, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {S_FUNDED} GROUP BY 1, 2, 3)
  SELECT f.*, s.sector_rounds, 100.0 * (rounds / sector_rounds) AS pct FROM f JOIN (SELECT sector, CAST(sum(rounds) AS BIGINT) AS sector_rounds FROM f GROUP BY 1) s USING (sector)""")
def sector_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    fine = _funded(spark, folder).groupBy("sector", "stage", "country").agg(F.count(F.lit(1)).alias("rounds"), F.sum(money("amount")).cast("double").alias("total"))
    coarse = fine.groupBy("sector").agg(F.sum("rounds").alias("sector_rounds"))
    return fine.join(coarse, "sector").withColumn("pct", 100.0 * ratio(F.col("rounds"), F.col("sector_rounds")))


@query("""WITH c AS (SELECT sector, count(*) AS n FROM (SELECT DISTINCT id, lower(trim(sector)) AS sector FROM startups_sample WHERE sector IS NOT NULL) GROUP BY 1)
  SELECT count(*) AS classes, max(n) / min(n) AS imbalance, arg_max(sector, (n, sector)) AS largest, quantile_cont(n, 0.95) * 2 AS twice_p95 FROM c""")
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "startups_sample").where("sector IS NOT NULL").select("id", F.lower(F.trim("sector")).alias("sector")).distinct()
    c = rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(
        F.count(F.lit(1)).alias("classes"), (F.max("n") / F.min("n")).alias("imbalance"),
        F.max_by("sector", F.struct("n", "sector")).alias("largest"), (F.percentile("n", F.lit(0.95)) * 2).alias("twice_p95"),
    )


# Series -----------------------------------------------------------------------------------------
S_DAYS = "(SELECT o_orderpriority AS route, CAST(o_orderdate AS DATE) AS day, count(*) AS rides FROM orders GROUP BY 1, 2)"


def _days(spark, folder):
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("route"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("rides"))


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, isodow(o_orderdate) - 1 AS day_of_week, isodow(o_orderdate) >= 6 AS is_weekend, month(o_orderdate) AS month,
  quarter(o_orderdate) AS quarter, weekofyear(o_orderdate) AS week_of_year, strftime(o_orderdate, '%Y-%m') AS year_month, day(o_orderdate) = 1 AS is_month_start,
  CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS is_month_end, sin(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(o_orderdate) - 1) / 7) AS dow_cos,
  sin(2 * pi() * month(o_orderdate) / 12) AS month_sin, cos(2 * pi() * month(o_orderdate) / 12) AS month_cos FROM orders""")
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("day", *[c.alias(n) for n, c in dates.calendar(F.col("day")).items()])


@query("""SELECT route, CAST(day + (7 - isodow(day)) * INTERVAL 1 DAY AS DATE) AS week, avg(rides) AS mean_rides, CAST(sum(rides) AS BIGINT) AS rides FROM """ + S_DAYS + " GROUP BY 1, 2")
def weekly_resample(spark: SparkSession, folder: str) -> DataFrame:
    return _days(spark, folder).groupBy("route", dates.week_ending_sunday(F.col("day")).alias("week")).agg(F.avg("rides").alias("mean_rides"), F.sum("rides").alias("rides"))


S_FORECAST = f"""(SELECT *, CASE WHEN count(rides) OVER w >= 7 THEN avg(rides) OVER w END AS forecast FROM {S_DAYS} WINDOW w AS (PARTITION BY route ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))"""


def _forecast(spark, folder):
    return series.seasonal_naive(_days(spark, folder), ["route"], "day", "rides")


@query(f"""SELECT route, count(*) AS n, avg(abs(rides - forecast)) AS mae, 100.0 * avg(abs((rides - forecast) / rides)) AS mape, sqrt(avg((rides - forecast) * (rides - forecast))) AS rmse,
  CASE WHEN 100.0 * avg(abs((rides - forecast) / rides)) > 35 THEN 'error' WHEN 100.0 * avg(abs((rides - forecast) / rides)) > 20 THEN 'warning' ELSE 'ok' END AS status
  FROM {S_FORECAST} WHERE forecast IS NOT NULL GROUP BY 1""")
def forecast_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return series.forecast_errors(_forecast(spark, folder), ["route"], "rides", "forecast")


@query(f"""WITH r AS (SELECT route, day, rides - forecast AS residual FROM {S_FORECAST} WHERE forecast IS NOT NULL),
  f AS (SELECT route, quantile_cont(residual, 0.25) AS q1, quantile_cont(residual, 0.75) AS q3, median(abs(residual)) AS mad FROM r GROUP BY 1 HAVING count(*) >= 14),
  z AS (SELECT r.*, q1, q3, mad, CASE WHEN count(*) OVER w >= 7 THEN avg(residual) OVER w END AS m, CASE WHEN count(*) OVER w >= 7 THEN stddev_samp(residual) OVER w END AS s
    FROM r JOIN f USING (route) WINDOW w AS (PARTITION BY route ORDER BY day ROWS 13 PRECEDING)),
  y AS (SELECT *, (residual - m) / CASE WHEN s > 0 THEN s WHEN mad > 0 THEN mad ELSE 1.0 END AS z FROM z)
  SELECT route, day, CASE WHEN abs(z) > 3 THEN 'critical' WHEN abs(z) > 2.5 THEN 'moderate' ELSE 'minor' END AS severity,
    CASE WHEN residual > 0 THEN 'HIGH' ELSE 'LOW' END AS direction FROM y WHERE abs(z) > 2 AND (residual < q1 - 1.5 * (q3 - q1) OR residual > q3 + 1.5 * (q3 - q1))""")
def rolling_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    found = series.residual_anomalies(_forecast(spark, folder), ["route"], "day", "rides", "forecast")
    return found.where("is_anomaly").select("route", "day", "severity", "direction")


@query(f"""WITH b AS (SELECT *, CASE WHEN count(rides) OVER w >= 14 THEN avg(rides) OVER w END AS baseline FROM {S_DAYS} WINDOW w AS (PARTITION BY route ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
  r AS (SELECT *, rides - baseline AS residual FROM b WHERE baseline IS NOT NULL),
  s AS (SELECT *, CASE WHEN count(*) OVER w >= 14 THEN stddev_samp(residual) OVER w END AS sd, stddev_samp(residual) OVER (PARTITION BY route) AS al FROM r
    WINDOW w AS (PARTITION BY route ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
  SELECT route, count(*) AS days, count_if(abs(residual / CASE WHEN sd > 0 THEN sd WHEN al > 0 THEN al ELSE 1.0 END) > 2) AS anomalies FROM s GROUP BY 1""")
def baseline_anomaly_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = series.baseline_anomalies(_days(spark, folder), ["route"], "day", "rides")
    return found.groupBy("route").agg(F.count(F.lit(1)).alias("days"), F.count_if("is_anomaly").alias("anomalies"))


@query("""WITH s AS (SELECT route, CAST(unnest(generate_series(min(service_date), max(service_date), INTERVAL 1 DAY)) AS DATE) AS service_date FROM cta_ridership_sample GROUP BY 1)
  SELECT route, service_date FROM s ANTI JOIN cta_ridership_sample USING (route, service_date)""")
def gap_days(spark: SparkSession, folder: str) -> DataFrame:
    return series.missing_days(table(spark, folder, "cta_ridership_sample"), ["route"], "service_date")


S_DID = f"(SELECT *, route = '1-URGENT' AS t, day >= DATE '1998-06-01' AS a FROM {S_DAYS} WHERE route IN ('1-URGENT', '5-LOW'))"


def _did(spark, folder):
    rows = _days(spark, folder).where(F.col("route").isin("1-URGENT", "5-LOW"))
    return rows.withColumn("t", F.col("route") == "1-URGENT").withColumn("a", F.col("day") >= F.lit("1998-06-01").cast("date"))


@query(f"""WITH c AS (SELECT t, a, count(*) AS n, avg(rides) AS m, var_samp(rides) AS v FROM {S_DID} GROUP BY 1, 2)
  SELECT CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN t = a THEN m ELSE -m END) AS did, sqrt(sum(v / (n - 1))) AS se, sum(CASE WHEN t = a THEN m ELSE -m END) / sqrt(sum(v / (n - 1))) AS z,
  sum(CASE WHEN t = a THEN m ELSE -m END) - 1.96 * sqrt(sum(v / (n - 1))) AS low, sum(CASE WHEN t = a THEN m ELSE -m END) + 1.96 * sqrt(sum(v / (n - 1))) AS high FROM c""")
def did_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return stats.difference_in_differences(_did(spark, folder), F.col("t"), F.col("a"), "rides")


@query(f"""SELECT CAST(floor(date_diff('day', DATE '1998-06-01', day) / 7) AS BIGINT) AS week, count(*) AS n, avg(rides) FILTER (t) - avg(rides) FILTER (NOT t) AS difference,
  sqrt(var_samp(rides) FILTER (t) / count(*) FILTER (t) + var_samp(rides) FILTER (NOT t) / count(*) FILTER (NOT t)) AS se FROM {S_DID} GROUP BY 1 HAVING count(*) >= 8""")
def event_study(spark: SparkSession, folder: str) -> DataFrame:
    rows = _did(spark, folder).withColumn("week", dates.relative_week(F.col("day"), "1998-06-01"))
    return stats.mean_difference(rows, ["week"], F.col("t"), "rides", 8)


S_CTA = "(SELECT DISTINCT route, service_date, rides, is_precipitation, temperature_2m, windspeed_10m, precipitation FROM cta_ridership_sample WHERE rides IS NOT NULL)"


def _cta(spark, folder):
    c = ["route", "service_date", "rides", "is_precipitation", "temperature_2m", "windspeed_10m", "precipitation"]
    return table(spark, folder, "cta_ridership_sample").where("rides IS NOT NULL").select(*c).distinct()


@query(f"""SELECT route, avg(rides) FILTER (is_precipitation) AS with_mean, avg(rides) FILTER (NOT is_precipitation) AS without_mean,
  100.0 * ((avg(rides) FILTER (is_precipitation) - avg(rides) FILTER (NOT is_precipitation)) / avg(rides) FILTER (NOT is_precipitation)) AS pct_change FROM {S_CTA} GROUP BY 1""")
def rain_effect(spark: SparkSession, folder: str) -> DataFrame:
    return series.lift_between(_cta(spark, folder), ["route"], F.col("is_precipitation"), "rides")


@query(f"""SELECT CASE WHEN temperature_2m IS NULL THEN 'unknown' WHEN temperature_2m < -10 THEN 'below -10' WHEN temperature_2m < 0 THEN '-10 to 0' WHEN temperature_2m < 10 THEN '0 to 10'
  WHEN temperature_2m < 20 THEN '10 to 20' WHEN temperature_2m < 30 THEN '20 to 30' ELSE '30 and more' END AS temperature, count(*) AS n,
  CAST(sum(least(100, CASE WHEN coalesce(precipitation, 0) > 5 THEN 35 WHEN coalesce(precipitation, 0) > 0.1 THEN 10 ELSE 0 END
    + CASE WHEN temperature_2m < -10 THEN 25 WHEN temperature_2m < 0 THEN 10 ELSE 0 END + CASE WHEN windspeed_10m > 50 THEN 20 WHEN windspeed_10m > 30 THEN 8 ELSE 0 END)) AS BIGINT) AS score_sum FROM {S_CTA} GROUP BY 1""")
def weather_scores(spark: SparkSession, folder: str) -> DataFrame:
    label = numbers.buckets(F.col("temperature_2m"), (-10, 0, 10, 20, 30), ("below -10", "-10 to 0", "0 to 10", "10 to 20", "20 to 30", "30 and more"), missing="unknown")
    score = numbers.weather_score(F.col("temperature_2m"), F.col("windspeed_10m"), F.col("precipitation"))
    return _cta(spark, folder).groupBy(label.alias("temperature")).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("score_sum"))


@query(f"SELECT corr(temperature_2m, rides) AS correlation, regr_slope(rides, temperature_2m) AS slope, regr_intercept(rides, temperature_2m) AS intercept FROM {S_CTA} WHERE temperature_2m IS NOT NULL")
def temperature_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return stats.correlation(_cta(spark, folder).where("temperature_2m IS NOT NULL"), "temperature_2m", "rides")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS in_last_hour FROM events""")
def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return series.trailing_count(e, "user_id", "ts", 3600, "in_last_hour").select("event_id", "user_id", "in_last_hour")


# Quality ----------------------------------------------------------------------------------------
CATEGORIES = ["electronics", "jewelery", "men's clothing", "women's clothing"]


def _product_rules():
    tidy = F.lower(F.trim("category"))
    return [Q.required("id"), Q.required("title"), Q.positive("price"), Q.length_between("title", 5, 200), Q.Rule("category: unknown value", tidy.isin(CATEGORIES)), Q.required("description")]


S_RULES = [
    ("id: missing", "id IS NOT NULL"), ("title: missing", "title IS NOT NULL"), ("price: not positive", "price IS NULL OR price > 0"),
    ("title: bad length", "title IS NULL OR length(title) BETWEEN 5 AND 200"),
    ("category: unknown value", "lower(trim(category)) IN ('electronics', 'jewelery', 'men''s clothing', 'women''s clothing')"), ("description: missing", "description IS NOT NULL"),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, count_if(NOT coalesce({c}, false)) AS rows FROM products_sample" for n, c in S_RULES))
def rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    return Q.violations(table(spark, folder, "products_sample"), _product_rules())


@query(f"""SELECT id, loaded_at, concat_ws('; ', {", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in S_RULES)}) AS validation_errors
  FROM products_sample WHERE NOT ({" AND ".join(f"coalesce({c}, false)" for _, c in S_RULES)})""")
def rejected_products(spark: SparkSession, folder: str) -> DataFrame:
    return Q.split(table(spark, folder, "products_sample"), _product_rules())[1].select("id", "loaded_at", "validation_errors")


@query(f"""SELECT id, loaded_at, title, price, rating.rate AS rating_rate, rating.count AS rating_count FROM products_sample WHERE {" AND ".join(f"coalesce({c}, false)" for _, c in S_RULES)}""")
def valid_products(spark: SparkSession, folder: str) -> DataFrame:
    good = Q.split(table(spark, folder, "products_sample"), _product_rules())[0]
    return Q.flatten(good.select("id", "loaded_at", "title", "price", "rating"), "rating")


@query("SELECT event_id, count(*) AS n FROM events_sample GROUP BY 1 HAVING count(*) > 1")
def duplicate_event_ids(spark: SparkSession, folder: str) -> DataFrame:
    return Q.not_unique(table(spark, folder, "events_sample"), ["event_id"])


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS value FROM events GROUP BY 1""")
def props_json(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy("p.k").agg(F.count(F.lit(1)).alias("n"), F.sum(money("value", 18, 4)).cast("double").alias("value"))


# Scores -----------------------------------------------------------------------------------------
S_SCORED = "(SELECT o_orderpriority AS grp, ((o_orderkey * 37) % 101 + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END) / 121.0 AS score, o_orderstatus = 'F' AS y FROM orders)"


def _scored(spark, folder):
    score = ((F.col("o_orderkey") * 37) % 101 + F.when(F.col("o_orderstatus") == "F", 20).otherwise(0)) / F.lit(121.0)
    return table(spark, folder, "orders").select(F.col("o_orderpriority").alias("grp"), score.alias("score"), (F.col("o_orderstatus") == "F").alias("y"))


@query(f"""WITH s AS (SELECT grp, score, count_if(y) AS pos, count_if(NOT y) AS neg FROM {S_SCORED} GROUP BY 1, 2),
  b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
  SELECT grp, CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY 1 HAVING sum(pos + neg) >= 50 AND sum(pos) >= 5""")
def auc_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return stats.auc(_scored(spark, folder), "score", F.col("y"), ["grp"], 50, 5)


@query(f"""SELECT t / 100.0 AS threshold, count_if(y AND score * 100 < t) AS fn, count_if(NOT y AND score * 100 >= t) AS fp,
  CAST(15000.0 * count_if(y AND score * 100 < t) + 500.0 * count_if(NOT y AND score * 100 >= t) AS DOUBLE) AS cost
  FROM (SELECT y, round(score * 100, 9) / 100 AS score FROM {S_SCORED}), generate_series(10, 89) g(t) GROUP BY t""")
def threshold_costs(spark: SparkSession, folder: str) -> DataFrame:
    return stats.threshold_costs(_scored(spark, folder), "score", F.col("y"), 15000.0, 500.0)


@query(f"""SELECT grp, count_if(y AND score >= 0.5) AS tp, count_if(NOT y AND score >= 0.5) AS fp, count_if(y AND score < 0.5) AS fn, count_if(NOT y AND score < 0.5) AS tn,
  count_if(y AND score >= 0.5) / nullif(count_if(score >= 0.5), 0) AS precision, count_if(y AND score >= 0.5) / nullif(count_if(y), 0) AS recall,
  2 * count_if(y AND score >= 0.5) / nullif(2 * count_if(y AND score >= 0.5) + count_if(NOT y AND score >= 0.5) + count_if(y AND score < 0.5), 0) AS f1 FROM {S_SCORED} GROUP BY 1""")
def confusion_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return stats.confusion(_scored(spark, folder), F.col("y"), F.col("score") >= 0.5, ["grp"])


@query(f"SELECT CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.6 THEN 'medium' ELSE 'high' END AS band, count(*) AS n, count_if(y) AS positives, avg(score) AS mean_score FROM {S_SCORED} GROUP BY 1")
def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    band = numbers.buckets(F.col("score"), (0.3, 0.6), ("low", "medium", "high"))
    return _scored(spark, folder).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("positives"), F.avg("score").alias("mean_score"))


@query(f"""WITH s AS (SELECT score, count_if(y) AS pos, count_if(NOT y) AS neg FROM {S_SCORED} GROUP BY 1),
  c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM s)
  SELECT score, tp / (SELECT sum(pos) FROM s) AS tpr, fp / (SELECT sum(neg) FROM s) AS fpr, tp / (tp + fp) AS precision FROM c""")
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return stats.roc_points(_scored(spark, folder), "score", F.col("y"))


@query("""WITH b AS (SELECT o_totalprice AS x FROM orders WHERE year(o_orderdate) < 1998), c AS (SELECT o_totalprice * 1.1 AS x FROM orders WHERE year(o_orderdate) >= 1998),
  e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM b),
  i AS (SELECT unnest(generate_series(1, len(e) - 1)) AS i, e FROM e),
  p AS (SELECT i, (SELECT count(*) FROM b WHERE x >= e[i] AND (x < e[i + 1] OR (i = len(e) - 1 AND x <= e[i + 1]))) / (SELECT count(*) FROM b) + 1e-6 AS pb,
    (SELECT count(*) FROM c WHERE x >= e[i] AND (x < e[i + 1] OR (i = len(e) - 1 AND x <= e[i + 1]))) / (SELECT count(*) FROM c) + 1e-6 AS pc FROM i)
  SELECT sum((pc - pb) * ln(pc / pb)) AS psi, CASE WHEN sum((pc - pb) * ln(pc / pb)) < 0.1 THEN 'STABLE' WHEN sum((pc - pb) * ln(pc / pb)) < 0.2 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS status FROM p""")
def psi_drift(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("x"))
    return stats.psi(o.where("y < 1998").select("x"), o.where("y >= 1998").select((F.col("x") * 1.1).alias("x")), "x")


# Text and retrieval -----------------------------------------------------------------------------
@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s.,]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM documents""")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words, length(text) BETWEEN 20 AND 2000 AS usual_length FROM documents WHERE text IS NOT NULL""")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.length("text").alias("chars"), F.size(text.words(F.col("text"))).alias("words"), F.length("text").between(20, 2000).alias("usual_length"))


S_TOPICS = [("refund|returned|price", "shopping"), ("route|bus|stop", "transit"), ("visa|student|credits", "study"), ("round|investor|founder", "funding")]


@query("SELECT topic, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN '{t}'" for p, t in S_TOPICS) + " ELSE 'other' END AS topic FROM documents) GROUP BY 1")
def topic_route(spark: SparkSession, folder: str) -> DataFrame:
    topic = retrieval.classify(F.col("text"), S_TOPICS, "other")
    return table(spark, folder, "documents").groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s"''<>)\\]]+')) AS u FROM documents)
  SELECT DISTINCT doc_id, regexp_replace(u, '[.,;:!?]+$', '') AS url FROM u""")
def document_links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.explode(text.urls(F.col("text"))).alias("url"))


@query("""WITH e AS (SELECT DISTINCT lower(trim(email)) AS email FROM users_sample WHERE email IS NOT NULL)
  SELECT email, split_part(email, '@', 2) AS host FROM e WHERE regexp_matches(email, '^[a-z0-9._%+-]+@[a-z0-9-]+(\\.[a-z0-9-]+)*\\.[a-z]{2,}$')""")
def pii_emails(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "users_sample").select(F.explode(text.emails(F.trim("email"))).alias("email")).distinct()
    return found.select("email", F.substring_index("email", "@", -1).alias("host"))


@query()
def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.chunk(table(spark, folder, "documents"), "doc_id", "text")


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT q, vec_id AS k, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings)
  SELECT q AS query_id, k AS "key", rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, k) AS rn FROM s) WHERE rn <= 10""")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    found = retrieval.cosine_top_k(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), "vec_id", "embedding")
    return found.select("query_id", "key", "position")


ASKED = ((1, "bus stop closed on sunday"), (2, "visa students credits per week"), (3, "refund price of the jacket"), (4, "seed round led by capital"))
S_ASKED = ", ".join(f"({i}, '{q}')" for i, q in ASKED)
S_BM25 = f"""WITH q AS (SELECT DISTINCT i, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS w FROM (VALUES {S_ASKED}) v(i, t)),
  d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
  n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
  t AS (SELECT doc_id, len, w, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY 1, 2, 3),
  f AS (SELECT w, count(*) AS df FROM t GROUP BY 1),
  s AS (SELECT i AS query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
    FROM t JOIN f USING (w) JOIN q USING (w), n GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM s)"""


def _bm25(spark, folder, k=10):
    asked = spark.createDataFrame(list(ASKED), "id int, q string")
    return retrieval.bm25(table(spark, folder, "documents"), "doc_id", {"text": 1.0}, asked, "id", "q", k)


@query(S_BM25 + " SELECT query_id, round(score, 6) AS score, position FROM r WHERE position <= 10")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder).select("query_id", F.round("score", 6).alias("score"), "position")


def _bm25_documents(spark, folder, k=10):
    docs = table(spark, folder, "documents")
    return retrieval.bm25(docs, "doc_id", {"text": 1.0}, docs.where("doc_id % 50 = 0"), "doc_id", "text", k)


@query()
def bm25_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of every 50th document asked of all documents (bm25_topk asks what its SQL asks)."""
    return _bm25_documents(spark, folder).select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


@query()
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical hits fused with those of a vector search; documents have no embeddings, so their vectors are hashed word counts."""
    docs = table(spark, folder, "documents").select("doc_id", text.words(F.col("text")).alias("w")).where("size(w) > 0")
    v = learning.hashed_words(docs, "w", 256).select("doc_id", learning.vector_to_array("features").alias("v"))
    near = retrieval.cosine_top_k(v, "doc_id", "v", v.where("doc_id % 50 = 0"), "doc_id", "v", 20, retrieval.BLOCK).withColumnRenamed("key", "doc_id")
    return retrieval.reciprocal_rank_fusion([_bm25_documents(spark, folder, 20), near], "doc_id")


@query("""WITH r AS (SELECT DISTINCT route, service_date FROM cta_ridership_sample WHERE route IS NOT NULL), h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(route || '-' || strftime(service_date, '%Y-%m-%d'))) AS h FROM r)
  SELECT route, service_date, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', instr('0123456789abcdef', h[17:17]) % 4 + CASE WHEN instr('0123456789abcdef', h[17:17]) % 4 = 0 THEN 4 ELSE 0 END, 1) || h[18:20] || '-' || h[21:32] AS event_id FROM h""")
def uuid5_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cta_ridership_sample").select("route", "service_date").distinct()
    return rows.withColumn("event_id", ids.uuid5(F.concat_ws("-", "route", F.date_format("service_date", "yyyy-MM-dd"))))


@query("SELECT DISTINCT route, service_date, substr(sha256(concat_ws('|', route, strftime(service_date, '%Y-%m-%d'))), 1, 32) AS content_id FROM cta_ridership_sample")
def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cta_ridership_sample").select("route", "service_date").distinct()
    return rows.withColumn("content_id", ids.content_id(F.col("route"), F.date_format("service_date", "yyyy-MM-dd")))


@query("SELECT a.label AS left_label, b.label AS right_label, count(*) AS pairs, avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS mean_similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1, 2")
def neighbour_similarity(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("right_label"))
    pairs = e.withColumnRenamed("label", "left_label").join(nxt, "vec_id")
    return pairs.groupBy("left_label", "right_label").agg(F.count(F.lit(1)).alias("pairs"), F.avg(vectors.cosine(F.col("embedding"), F.col("other"))).alias("mean_similarity"))


@query(f"""WITH c AS (SELECT isodow(day) >= 6 AS weekend, t, a, count(*) AS n, avg(rides) AS m, var_samp(rides) AS v FROM {S_DID} GROUP BY 1, 2, 3)
  SELECT weekend, CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN t = a THEN m ELSE -m END) AS did, sqrt(sum(v / (n - 1))) AS se FROM c GROUP BY 1""")
def did_by_weekend(spark: SparkSession, folder: str) -> DataFrame:
    rows = _did(spark, folder).withColumn("weekend", F.weekday("day") >= 5)
    return stats.difference_in_differences(rows, F.col("t"), F.col("a"), "rides", ["weekend"]).select("weekend", "n", "did", "se")


@query(f"""WITH c AS (SELECT shift, t, day >= DATE '1998-06-01' + shift AS a, avg(rides) AS m FROM {S_DID}, (VALUES (-14), (0), (14)) s(shift) GROUP BY 1, 2, 3)
  SELECT shift, sum(CASE WHEN t = a THEN m ELSE -m END) AS did FROM c GROUP BY 1""")
def did_robustness(spark: SparkSession, folder: str) -> DataFrame:
    rows = _did(spark, folder).withColumn("shift", F.explode(F.array(F.lit(-14), F.lit(0), F.lit(14))))
    after = F.col("day") >= F.date_add(F.lit("1998-06-01").cast("date"), F.col("shift"))
    return stats.difference_in_differences(rows, F.col("t"), after, "rides", ["shift"]).select("shift", "did")


@query(f"""SELECT t AS treated, avg(rides) FILTER (NOT a) AS before, avg(rides) FILTER (a) AS after, avg(rides) FILTER (a) - avg(rides) FILTER (NOT a) AS change FROM {S_DID} GROUP BY 1""")
def did_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    out = _did(spark, folder).groupBy(F.col("t").alias("treated")).agg(F.avg(F.when(~F.col("a"), F.col("rides"))).alias("before"), F.avg(F.when(F.col("a"), F.col("rides"))).alias("after"))
    return out.withColumn("change", F.col("after") - F.col("before"))


@query("""WITH p AS (SELECT route, avg(rides) FILTER (kind = 'W') AS w, avg(rides) FILTER (kind = 'A') AS a, avg(rides) FILTER (kind = 'U') AS u FROM
  (SELECT DISTINCT route, service_date, rides, upper(trim(day_type)) AS kind FROM cta_ridership_sample WHERE rides IS NOT NULL AND day_type IS NOT NULL) GROUP BY 1)
  SELECT route, w / greatest(w, a, u) AS "W", a / greatest(w, a, u) AS "A", u / greatest(w, a, u) AS "U" FROM p""")
def day_type_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cta_ridership_sample").where("rides IS NOT NULL AND day_type IS NOT NULL")
    rows = rows.select("route", "service_date", "rides", F.upper(F.trim("day_type")).alias("kind")).distinct()
    return R.row_profile(R.pivot(rows, ["route"], "kind", ["W", "A", "U"], F.avg("rides")), ["W", "A", "U"])


@query("""WITH r AS (SELECT route, temperature_2m, windspeed_10m, row_number() OVER (PARTITION BY route ORDER BY service_date DESC) AS n FROM
  (SELECT DISTINCT route, service_date, temperature_2m, windspeed_10m FROM cta_ridership_sample WHERE temperature_2m IS NOT NULL))
  SELECT route, avg(temperature_2m) AS temperature_2m, avg(windspeed_10m) AS windspeed_10m FROM r WHERE n <= 30 GROUP BY 1""")
def recent_weather(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cta_ridership_sample").where("temperature_2m IS NOT NULL").select("route", "service_date", "temperature_2m", "windspeed_10m").distinct()
    return series.last_rows_mean(rows, ["route"], "service_date", ["temperature_2m", "windspeed_10m"])


@query(f"""WITH s AS (SELECT score, count_if(y) AS pos, count_if(NOT y) AS neg, grp FROM {S_SCORED} GROUP BY score, grp),
  b AS (SELECT grp, pos, neg, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
  o AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM s GROUP BY 1)),
  g AS (SELECT grp, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY 1)
  SELECT grp, auc, auc - (SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) FROM o) AS gap FROM g""")
def fairness_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder)
    groups = stats.auc(rows, "score", F.col("y"), ["grp"], 50, 5).select("grp", "auc")
    return stats.gaps_to_overall(groups, stats.auc(rows, "score", F.col("y")), "auc")


@query(f"""SELECT count(*) AS n, avg(score) AS mean, count_if(score >= 0.5) / count(*) AS flagged_rate,
  list_sort(list(score))[CAST(floor(count(*) * 0.95) AS INTEGER) + 1] AS p95 FROM {S_SCORED}""")
def monitoring_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.monitoring(_scored(spark, folder), "score", F.col("score") >= 0.5, F.col("grp")).drop("distribution")


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM documents WHERE text IS NOT NULL),
  g AS (SELECT k, min(doc_id) AS first_key, count(*) AS copies FROM t GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, first_key, copies FROM t JOIN g USING (k)""")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return R.near_copies(table(spark, folder, "documents"), "doc_id", text.plain(F.col("text")))


def _s_psi(column: str) -> str:
    return f"""(WITH b AS (SELECT {column} AS x FROM orders WHERE year(o_orderdate) < 1998), c AS (SELECT {column} AS x FROM orders WHERE year(o_orderdate) >= 1998),
  e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM b), i AS (SELECT unnest(generate_series(1, len(e) - 1)) AS i, e FROM e),
  p AS (SELECT i, (SELECT count(*) FROM b WHERE x >= e[i] AND (x < e[i + 1] OR (i = len(e) - 1 AND x <= e[i + 1]))) / (SELECT count(*) FROM b) + 1e-6 AS pb,
    (SELECT count(*) FROM c WHERE x >= e[i] AND (x < e[i + 1] OR (i = len(e) - 1 AND x <= e[i + 1]))) / (SELECT count(*) FROM c) + 1e-6 AS pc FROM i) SELECT sum((pc - pb) * ln(pc / pb)) FROM p)"""


@query(f"""WITH p AS (SELECT 'o_totalprice' AS "column", {_s_psi('o_totalprice')} AS psi UNION ALL SELECT 'customer', {_s_psi('CAST(o_custkey AS DOUBLE)')})
  SELECT *, CASE WHEN psi < 0.1 THEN 'STABLE' WHEN psi < 0.2 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS status, psi >= 0.2 AS alert FROM p""")
def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.year("o_orderdate").alias("y"), "o_totalprice", F.col("o_custkey").alias("customer"))
    return stats.drift_report(o.where("y < 1998"), o.where("y >= 1998"), ["o_totalprice", "customer"])


# Learning ---------------------------------------------------------------------------------------
def _order_rows(spark, folder):
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", "o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment", (F.col("o_totalprice") > 150_000).cast("int").alias("label"))


@query()
def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = _order_rows(spark, folder)
    f = learning.Features(["o_totalprice", "c_acctbal"], {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}, ["c_mktsegment"]).fit(rows)
    return f.transform(rows).select("o_orderkey", learning.vector_to_array("features").alias("features"))


@query()
def label_split(spark: SparkSession, folder: str) -> DataFrame:
    train, test = learning.stratified_split(_order_rows(spark, folder), "o_orderkey", "label")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query()
def embedding_components(spark: SparkSession, folder: str) -> DataFrame:
    found = learning.principal_components(table(spark, folder, "embeddings"), "embedding")
    return found.select("vec_id", F.transform("components", lambda x: F.round(F.abs(x), 6)).alias("components"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
  t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
  v AS (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 2000),
  x AS (SELECT doc_id, term, (1 + ln(tf)) * (1 + ln((1 + n) / (1 + df))) AS x FROM t JOIN v USING (term), n),
  y AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM x)
  SELECT doc_id, count(*) AS terms, round(sum(weight), 5) AS total, round(max(weight), 5) AS largest FROM y GROUP BY 1""")
def tf_idf_weights(spark: SparkSession, folder: str) -> DataFrame:
    w = learning.tf_idf(table(spark, folder, "documents"), "doc_id", "text", 2000, grams=1)
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("largest"))


@query()
def tf_idf_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The weights of the 5,000 most frequent words and word pairs (tf_idf_weights has what its SQL has)."""
    w = learning.tf_idf(table(spark, folder, "documents"), "doc_id", "text")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query()
def sector_classifier(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "startups_sample").where("sector IS NOT NULL AND description IS NOT NULL").select("id", F.lower(F.trim("sector")).alias("sector"), "description").distinct()
    coded = learning.label_codes(rows, "sector", "label")
    tokens = coded.withColumn("w", text.words(F.col("description")))
    hashed = learning.hashed_words(tokens, "w", 1024)
    train, test = learning.stratified_split(hashed, "id", "label")
    model = learning.LogisticRegression(featuresCol="features", labelCol="label", maxIter=20, regParam=0.01).fit(train)
    return learning.class_report(model.transform(test), "label", "prediction")


@query()
def ridership_forecast(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cta_ridership_sample").where("rides > 0").select("route", "service_date", "rides").distinct()
    return learning.seasonal_regression(rows, "route", "service_date", "rides", "2023-12-01")


@query()
def weather_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _cta(spark, folder).where("temperature_2m IS NOT NULL AND windspeed_10m IS NOT NULL AND precipitation IS NOT NULL")
    return learning.importances(rows, ["temperature_2m", "windspeed_10m", "precipitation"], "rides")
