"""Lifetime value, given sessions, forecast joins, curves and gaps, weather joins, text signals, contracts and series helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import dates, ids, numbers, text
from millrace.functions.numbers import money, ratio
from millrace.operators import quality as Q
from millrace.operators import reports as R
from millrace.operators import learning, retrieval, series, stats, upsert
from millrace.plans.analytics import AS_OF, S_DAYS, S_DID, S_SCORED, _days, _did, _scored, total
from millrace.runtime import cut, table

QUERIES, SQL, ROUNDED = {}, {}, {}


def query(sql: str | None = None, rounded: tuple[str, ...] = ()):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        if rounded:
            ROUNDED[fn.__name__] = list(rounded)
        return fn

    return add


# Customers --------------------------------------------------------------------------------------
@query(f"""WITH b AS (SELECT o_custkey AS customer, CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) AS DOUBLE) AS spend, count(*) AS orders,
    date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{AS_OF}') AS idle_days FROM orders GROUP BY 1)
  SELECT c_custkey AS customer, coalesce(spend, 0) AS spend, coalesce(orders, 0) AS orders,
    CASE WHEN coalesce(spend, 0) >= 2000000 THEN 'platinum' WHEN coalesce(spend, 0) >= 1000000 THEN 'gold' WHEN coalesce(spend, 0) >= 500000 THEN 'silver' ELSE 'bronze' END AS tier,
    coalesce(idle_days > 60, true) AS churned, coalesce(spend >= 1000000 AND idle_days BETWEEN 30 AND 60, false) AS at_risk
  FROM customer LEFT JOIN b ON customer = c_custkey""")
def customer_ltv(spark: SparkSession, folder: str) -> DataFrame:
    """Value tier, churn and at-risk flags of every customer; one without orders is in the lowest tier and churned."""
    base = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        total().alias("spend"), F.count(F.lit(1)).alias("orders"),
        F.datediff(F.lit(AS_OF).cast("date"), F.max("o_orderdate").cast("date")).alias("idle"),
    )
    spend = F.coalesce("spend", F.lit(0.0))
    return table(spark, folder, "customer").join(base, "c_custkey", "left").select(
        F.col("c_custkey").alias("customer"), spend.alias("spend"), F.coalesce("orders", F.lit(0)).alias("orders"),
        numbers.buckets(spend, (500_000, 1_000_000, 2_000_000), ("bronze", "silver", "gold", "platinum")).alias("tier"),
        F.coalesce(F.col("idle") > 60, F.lit(True)).alias("churned"),
        F.coalesce((F.col("spend") >= 1_000_000) & F.col("idle").between(30, 60), F.lit(False)).alias("at_risk"),
    )


_ONCE = """(SELECT event_id, arg_min(session_id, (received_at, session_id)) AS session_id, arg_min(lower(event_type), (received_at, lower(event_type))) AS event_type,
  arg_min("timestamp", (received_at, "timestamp")) AS ts, arg_min(product_id, (received_at, product_id)) AS product_id FROM events_sample GROUP BY 1)"""


@query(f"""SELECT session_id, min(ts) AS start, max(ts) AS "end", count(*) AS events, count(DISTINCT event_type) AS types, count(DISTINCT product_id) AS products,
  bool_or(event_type = 'purchase') AS has_purchase, bool_or(event_type = 'add_to_cart') AS has_cart,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'add_to_cart') THEN 'cart' ELSE 'browse' END AS furthest
  FROM {_ONCE} WHERE session_id IS NOT NULL GROUP BY 1""")
def given_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The clickstream by the session number that the client gave; repeats of an event count once."""
    e = table(spark, folder, "events_sample").withColumn("kind", F.lower("event_type"))
    once = e.groupBy("event_id").agg(*[
        F.min_by(c, F.struct("received_at", c)).alias(n) for c, n in (("session_id", "session_id"), ("kind", "event_type"), ("timestamp", "ts"), ("product_id", "product_id"))
    ])
    bought, carted = F.bool_or(F.col("event_type") == "purchase"), F.bool_or(F.col("event_type") == "add_to_cart")
    return once.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"), F.count_distinct("event_type").alias("types"),
        F.count_distinct("product_id").alias("products"), bought.alias("has_purchase"), carted.alias("has_cart"),
    ).withColumn("furthest", F.when(F.col("has_purchase"), "purchase").when(F.col("has_cart"), "cart").otherwise("browse"))


@query("""SELECT l_orderkey AS order_key, arg_min(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_returnflag)) AS first_flag, min(l_shipdate) AS first_shipped FROM lineitem GROUP BY 1""")
def first_item_per_order(spark: SparkSession, folder: str) -> DataFrame:
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_returnflag")
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.min_by("l_returnflag", order).alias("first_flag"), F.min("l_shipdate").alias("first_shipped")
    )


_RETURNED = "(SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R')"


@query(f"""SELECT o_orderpriority AS priority, count(*) AS rows, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS returned, avg(l_quantity) AS mean_quantity
  FROM orders LEFT JOIN {_RETURNED} ON o_orderkey = l_orderkey GROUP BY 1""", ("mean_quantity",))
def returns_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with all of their returned lines: an order has as many rows as lines, or one without any."""
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    both = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("orders"), F.count("l_linenumber").alias("returned"), F.avg("l_quantity").alias("mean_quantity")
    )


@query(f"""SELECT o_orderpriority AS priority, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size, count(*) AS rows,
  CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) AS DOUBLE) AS value FROM orders JOIN {_RETURNED} ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def returns_by_size(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_quantity")
    both = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    size = numbers.buckets(F.col("l_quantity"), (10, 30), ("few", "some", "many"))
    return both.groupBy(F.col("o_orderpriority").alias("priority"), size.alias("size")).agg(F.count(F.lit(1)).alias("rows"), total().alias("value"))


@query("""WITH t AS (SELECT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1 ORDER BY sum(CAST(l_extendedprice AS DECIMAL(12, 2))) DESC, p_brand LIMIT 5)
  SELECT p_brand AS brand, p_type AS type, count(*) AS parts, max(p_size) AS largest FROM part WHERE p_brand IN (SELECT p_brand FROM t) GROUP BY 1, 2""")
def parts_of_top_brands(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the five groups that are largest by another measure."""
    part = table(spark, folder, "part")
    sold = table(spark, folder, "lineitem").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    best = sold.groupBy("p_brand").agg(F.sum(money("l_extendedprice", 12, 2)).alias("s")).orderBy(F.desc("s"), "p_brand").limit(5)
    kept = part.join(best.select("p_brand"), "p_brand", "left_semi")
    return kept.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("parts"), F.max("p_size").alias("largest"))


@query("""WITH g AS (SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'home' WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'machines' ELSE 'other' END AS grp, c_acctbal FROM customer)
  SELECT grp, count(*) AS customers, count_if(c_acctbal < 0) AS in_debt, 100.0 * (count_if(c_acctbal < 0) / count(*)) AS pct FROM g GROUP BY 1""", ("pct",))
def segment_groups(spark: SparkSession, folder: str) -> DataFrame:
    grp = F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "home").when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), "machines").otherwise("other")
    out = table(spark, folder, "customer").groupBy(grp.alias("grp")).agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))
    return out.withColumn("pct", 100.0 * ratio(F.col("in_debt"), F.col("customers")))


# Funding stages in their order.
STAGES = ("pre-seed", "seed", "series a", "series b", "series c", "series d", "growth")


@query(f"""WITH s AS (SELECT DISTINCT id, lower(trim(stage)) AS stage, traction_signal, employee_count FROM startups_sample)
  SELECT id, stage, coalesce(CASE stage {" ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(STAGES))} END, -1) AS stage_rank,
    TRY_CAST(nullif(regexp_extract(traction_signal, '^(\\d+) ', 1), '') AS DOUBLE) AS signal, CASE WHEN employee_count IS NOT NULL THEN greatest(0, least(500, employee_count)) END AS employees FROM s""")
def stage_ranks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "startups_sample").select("id", F.lower(F.trim("stage")).alias("stage"), "traction_signal", "employee_count").distinct()
    number = F.regexp_extract(F.col("traction_signal"), r"^(\d+) ", 1)
    return rows.select(
        "id", "stage", numbers.lookup(F.col("stage"), {x: i for i, x in enumerate(STAGES)}, -1).alias("stage_rank"), numbers.number(F.nullif(number, F.lit(""))).alias("signal"),
        numbers.clip(F.col("employee_count"), 0, 500).alias("employees"),
    )


@query("""SELECT DISTINCT id, nullif(trim(username), '') AS username, loaded_at, deleted_at IS NULL AS present FROM users_sample""")
def staged_users(spark: SparkSession, folder: str) -> DataFrame:
    """Users without their personal columns; blank texts are NULL."""
    rows = table(spark, folder, "users_sample").drop("email")
    rows = rows.withColumn("username", F.trim("username")).replace("", None)
    return rows.select("id", "username", "loaded_at", F.col("deleted_at").isNull().alias("present")).distinct()


@query("""SELECT (CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END) + (CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) AS settled, count(*) AS lines,
  avg(CASE WHEN l_returnflag = 'R' THEN 100.0 ELSE 0 END) AS returned_pct FROM lineitem GROUP BY 1""", ("returned_pct",))
def settled_marks(spark: SparkSession, folder: str) -> DataFrame:
    marks = numbers.count_differing(["l_returnflag"], "N") + numbers.count_differing(["l_linestatus"], "O")
    return table(spark, folder, "lineitem").groupBy(marks.alias("settled")).agg(
        F.count(F.lit(1)).alias("lines"), F.avg(F.when(F.col("l_returnflag") == "R", 100.0).otherwise(0)).alias("returned_pct")
    )


_CODE = "CASE o_orderkey % 13 WHEN 0 THEN 'E' || (o_orderkey % 900) WHEN 1 THEN 'V' || (o_orderkey % 90) WHEN 2 THEN '250.' || (o_orderkey % 10) WHEN 3 THEN '?' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END"


@query(f"""WITH c AS (SELECT {_CODE} AS code FROM orders), v AS (SELECT code, TRY_CAST(code AS DOUBLE) AS v FROM c)
  SELECT CASE WHEN code LIKE '250%' THEN 'Diabetes' WHEN code LIKE 'E%' OR code LIKE 'V%' THEN 'Other' {" ".join(f"WHEN v BETWEEN {a} AND {b} THEN '{g}'" for a, b, g in numbers.ICD9_RANGES)} ELSE 'Other' END AS grp,
    count(*) AS n, count(DISTINCT code) AS codes FROM v GROUP BY 1""")
def code_groups(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.when(k % 13 == 0, F.concat(F.lit("E"), k % 900)).when(k % 13 == 1, F.concat(F.lit("V"), k % 90)).when(k % 13 == 2, F.concat(F.lit("250."), k % 10))
    code = code.when(k % 13 == 3, "?").otherwise((k % 1000).cast("string"))
    rows = table(spark, folder, "orders").select(code.alias("code"))
    return rows.groupBy(numbers.icd9_group(F.col("code")).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("codes"))


# Forecasts --------------------------------------------------------------------------------------
_WEEK = f"(SELECT route, CAST(day + INTERVAL 7 DAY AS DATE) AS day, rides AS forecast FROM {S_DAYS})"


def _week_ahead(spark, folder):
    d = _days(spark, folder)
    return d.select("route", F.date_add("day", 7).alias("day"), F.col("rides").alias("forecast"))


@query(f"""WITH j AS (SELECT f.route, f.day, forecast, rides, rides IS NOT NULL AS is_actual, rides - forecast AS residual FROM {_WEEK} f LEFT JOIN {S_DAYS} d ON f.route = d.route AND f.day = d.day),
  r AS (SELECT *, CASE WHEN count(residual) OVER w >= 7 THEN stddev_samp(residual) OVER w END AS own FROM j WINDOW w AS (PARTITION BY route ORDER BY day ROWS 13 PRECEDING))
  SELECT route, day, forecast, rides, is_actual, coalesce(own, avg(own) OVER (PARTITION BY route)) AS spread FROM r""", ("spread",))
def forecast_actuals(spark: SparkSession, folder: str) -> DataFrame:
    """Every forecast with its actual value if there is one, and the rolling spread of the residuals; where that is
    NULL, the mean of the series' rolling spreads."""
    return series.forecast_with_actuals(_week_ahead(spark, folder), _days(spark, folder), ["route"], "day", "forecast", "rides")


@query(f"""WITH j AS (SELECT route, rides, forecast FROM {_WEEK} JOIN {S_DAYS} USING (route, day)),
  e AS (SELECT route, count(*) AS n, avg(abs(rides - forecast)) AS mae, 100.0 * avg(abs((rides - forecast) / rides)) AS mape FROM j GROUP BY 1)
  SELECT *, row_number() OVER (ORDER BY mape, route) AS place FROM e""", ("mae", "mape"))
def accuracy_table(spark: SparkSession, folder: str) -> DataFrame:
    both = _week_ahead(spark, folder).join(_days(spark, folder), ["route", "day"])
    found = series.forecast_errors(both, ["route"], "rides", "forecast").select("route", "n", "mae", "mape")
    return found.withColumn("place", F.row_number().over(Window.orderBy("mape", "route")))


@query(f"""WITH b AS (SELECT min(day) AS a, max(day) AS z FROM {S_DAYS}), c AS (SELECT CAST(unnest(generate_series(a + INTERVAL 180 DAY, z - INTERVAL 28 DAY, INTERVAL 360 DAY)) AS DATE) AS cutoff FROM b)
  SELECT cutoff, CASE WHEN day <= cutoff THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM c JOIN {S_DAYS} ON day <= cutoff + INTERVAL 28 DAY GROUP BY 1, 2""")
def origin_folds(spark: SparkSession, folder: str) -> DataFrame:
    return series.rolling_origins(_days(spark, folder), "day", 180, 360, 28).groupBy("cutoff", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE WHEN day <= (SELECT max(day) FROM {S_DAYS}) - INTERVAL 28 DAY THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM {S_DAYS} GROUP BY 1""")
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    train, test = learning.temporal_split(_days(spark, folder), "day")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


# Scores -----------------------------------------------------------------------------------------
@query(f"""WITH s AS (SELECT grp, score, count_if(y) AS pos, count_if(NOT y) AS neg FROM {S_SCORED} GROUP BY 1, 2),
  c AS (SELECT grp, pos, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
  SELECT grp, sum(pos * (tp / n)) / sum(pos) AS average_precision FROM c GROUP BY 1""", ("average_precision",))
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return stats.average_precision(_scored(spark, folder), "score", F.col("y"), ["grp"])


@query(f"""WITH c AS (SELECT t, count_if(y AND s >= t) AS tp, count_if(NOT y AND s >= t) AS fp, count_if(y AND s < t) AS fn FROM (SELECT y, round(score * 100, 9) AS s FROM {S_SCORED}), generate_series(5, 94) g(t) GROUP BY 1)
  SELECT t / 100.0 AS threshold, fn, fp, CAST(fn * 15000.0 + fp * 500.0 AS DOUBLE) AS cost, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c""",
  ("precision", "recall", "f1"))
def threshold_curve(spark: SparkSession, folder: str) -> DataFrame:
    return stats.threshold_curve(_scored(spark, folder), "score", F.col("y"), 15000.0, 500.0, 5, 94)


@query(f"""WITH g AS (SELECT grp, count_if(y AND score >= 0.5) / count_if(y) AS recall FROM {S_SCORED} GROUP BY 1)
  SELECT grp, recall, recall - (SELECT count_if(y AND score >= 0.5) / count_if(y) FROM {S_SCORED}) AS gap FROM g""", ("recall", "gap"))
def recall_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows, flagged = _scored(spark, folder), F.col("score") >= 0.5
    groups = stats.confusion(rows, F.col("y"), flagged, ["grp"]).select("grp", "recall")
    return stats.gaps_to_overall(groups, stats.confusion(rows, F.col("y"), flagged), "recall")


@query(f"SELECT grp AS label, count(*) AS n FROM {S_SCORED} GROUP BY 1")
def score_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """The count map of the monitoring statistics, one row per entry."""
    one = stats.monitoring(_scored(spark, folder), "score", F.col("score") >= 0.5, F.col("grp"))
    return one.select(F.explode("distribution").alias("label", "n"))


@query(f"""WITH o AS (SELECT o_orderpriority AS grp, o_totalprice, o_orderkey % 1000 AS serial, o_orderstatus = 'F' AS y FROM orders),
  f AS (UNPIVOT (SELECT y, o_totalprice, CAST(serial AS DOUBLE) AS serial FROM o) ON o_totalprice, serial INTO NAME feature VALUE v)
  SELECT feature, avg(v) FILTER (y) AS with_label, avg(v) FILTER (NOT y) AS without_label, avg(v) FILTER (y) - avg(v) FILTER (NOT y) AS difference FROM f GROUP BY 1""",
  ("with_label", "without_label", "difference"))
def class_mean_gaps(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_totalprice", (F.col("o_orderkey") % 1000).cast("double").alias("serial"), (F.col("o_orderstatus") == "F").alias("y"))
    return stats.class_means(o, ["o_totalprice", "serial"], F.col("y"))


@query("""WITH e AS (SELECT count(*) AS n, count(user_id) AS user_id, count(session_id) AS session_id, count(channel) AS channel, count(product_id) AS product_id FROM events_sample)
  SELECT name AS "column", 100.0 * (v / n) AS pct FROM (UNPIVOT e ON user_id, session_id, channel, product_id INTO NAME name VALUE v)""", ("pct",))
def filled_percent(spark: SparkSession, folder: str) -> DataFrame:
    """How many percent of the rows use a column, one row per column."""
    return R.share_of_columns(table(spark, folder, "events_sample"), {c: F.col(c).isNotNull() for c in ("user_id", "session_id", "channel", "product_id")})


# Experiments and effects ------------------------------------------------------------------------
_ARMS = "(SELECT o_custkey % 2 AS arm, count(*) AS n, count_if(o_orderstatus = 'F') AS x FROM orders GROUP BY 1)"


@query("""SELECT * FROM (VALUES (0.1, 0.02, 3835), (0.38, 0.02, 9335), (0.5, 0.1, 388)) t(baseline, lift, n)""")
def sample_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(b, d, stats.sample_size(b, d)) for b, d in ((0.1, 0.02), (0.38, 0.02), (0.5, 0.1))]
    return spark.createDataFrame(rows, "baseline double, lift double, n int")


_CDF = """CASE WHEN {z} >= 0 THEN 1 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {p} ELSE exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {p} END"""
_POLY = "(1 / (1 + 0.2316419 * abs({z}))) * (0.319381530 + (1 / (1 + 0.2316419 * abs({z}))) * (-0.356563782 + (1 / (1 + 0.2316419 * abs({z}))) * (1.781477937 + (1 / (1 + 0.2316419 * abs({z}))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs({z}))) * 1.330274429))))"


def _s_cdf(z: str) -> str:
    return _CDF.format(z=z, p=_POLY.format(z=z))


@query(f"""WITH a AS (SELECT * FROM {_ARMS} WHERE arm = 0), b AS (SELECT * FROM {_ARMS} WHERE arm = 1),
  t AS (SELECT a.x / a.n AS rate_a, b.x / b.n AS rate_b, (a.x + b.x) / (a.n + b.n) AS p, a.n AS na, b.n AS nb FROM a, b),
  z AS (SELECT *, (rate_b - rate_a) / sqrt(p * (1 - p) * (1 / na + 1 / nb)) AS z, 1.959963984540054 * sqrt(rate_a * (1 - rate_a) / na + rate_b * (1 - rate_b) / nb) AS wide FROM t)
  SELECT rate_a, rate_b, rate_b - rate_a AS lift, (rate_b - rate_a) / rate_a AS relative, z, 1 - ({_s_cdf('z')}) AS p_value, rate_b - rate_a - wide AS low, rate_b - rate_a + wide AS high FROM z""",
  ("rate_a", "rate_b", "lift", "relative", "z", "p_value", "low", "high"))
def conversion_test(spark: SparkSession, folder: str) -> DataFrame:
    """The whole test of two proportions: one-sided p-value and two-sided interval."""
    o = table(spark, folder, "orders")
    return stats.proportion_test(o, F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 2 == 1, F.col("o_orderstatus") == "F")


@query("""WITH a AS (SELECT o_custkey % 2 AS arm, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
  w AS (SELECT max(m) FILTER (arm = 0) AS mean_a, max(m) FILTER (arm = 1) AS mean_b, max(v / n) FILTER (arm = 0) AS u, max(v / n) FILTER (arm = 1) AS w, max(n) FILTER (arm = 0) AS na, max(n) FILTER (arm = 1) AS nb FROM a)
  SELECT mean_a, mean_b, (mean_b - mean_a) / sqrt(u + w) AS t, (u + w) * (u + w) / (u * u / (na - 1) + w * w / (nb - 1)) AS df,
    abs((mean_b - mean_a) / sqrt(u + w)) < 1.96 OR mean_b >= mean_a AS passes FROM w""", ("mean_a", "mean_b", "t", "df"))
def guardrail_test(spark: SparkSession, folder: str) -> DataFrame:
    """Welch's t with the guardrail rule: not significant (large samples: |t| below 1.96), or the treatment is no worse."""
    o = table(spark, folder, "orders").withColumn("arm", F.col("o_custkey") % 2)
    return stats.welch_guardrail(o, F.col("arm") == 0, F.col("arm") == 1, "o_totalprice")


@query(f"""WITH c AS (SELECT t, a, count(*) AS n, avg(rides) AS m, var_samp(rides) AS v FROM {S_DID} GROUP BY 1, 2),
  e AS (SELECT sum(CASE WHEN t = a THEN m ELSE -m END) AS did, sqrt(sum(v / (n - 1))) AS se, sum(v * (n - 1)) AS sse FROM c), s AS (SELECT var_samp(rides) * (count(*) - 1) AS sst FROM {S_DID}),
  q AS (SELECT did, se, abs(did / se) AS z, 1 - sse / sst AS r2 FROM e, s)
  SELECT did, se, r2, 2 * (1 - ({_s_cdf('z')})) AS p_value FROM q""", ("did", "se", "r2", "p_value"))
def did_significance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _did(spark, folder)
    return stats.did_fit(rows, F.col("t"), F.col("a"), "rides")


@query(f"""WITH q AS (SELECT avg(rides) FILTER (t AND NOT a) AS tb, avg(rides) FILTER (t AND a) AS ta, avg(rides) FILTER (NOT t AND NOT a) AS cb, avg(rides) FILTER (NOT t AND a) AS ca FROM {S_DID})
  SELECT tb AS treated_before, ta AS treated_after, cb AS control_before, ca AS control_after, tb + ca - cb AS counterfactual, ta - (tb + ca - cb) AS effect FROM q""",
  ("treated_before", "treated_after", "control_before", "control_after", "counterfactual", "effect"))
def did_counterfactual(spark: SparkSession, folder: str) -> DataFrame:
    m = lambda c: F.avg(F.when(c, F.col("rides")))
    t, a = F.col("t"), F.col("a")
    q = _did(spark, folder).agg(m(t & ~a).alias("treated_before"), m(t & a).alias("treated_after"), m(~t & ~a).alias("control_before"), m(~t & a).alias("control_after"))
    q = q.withColumn("counterfactual", F.col("treated_before") + F.col("control_after") - F.col("control_before"))
    return q.withColumn("effect", F.col("treated_after") - F.col("counterfactual"))


# Ridership and weather --------------------------------------------------------------------------
_RIDES = "(SELECT DISTINCT route, service_date, rides, upper(trim(day_type)) AS kind FROM cta_ridership_sample WHERE rides IS NOT NULL)"


def _rides(spark, folder):
    rows = table(spark, folder, "cta_ridership_sample").where("rides IS NOT NULL")
    return rows.select("route", "service_date", "rides", F.upper(F.trim("day_type")).alias("kind")).distinct()


@query(f"""SELECT route, count(*) AS days, avg(rides) AS mean, stddev_samp(rides) AS deviation, CAST(sum(rides) AS BIGINT) AS rides, stddev_samp(rides) / avg(rides) AS variation
  FROM {_RIDES} GROUP BY 1 ORDER BY variation DESC, route LIMIT 15""", ("mean", "deviation", "variation"))
def most_variable_routes(spark: SparkSession, folder: str) -> DataFrame:
    out = _rides(spark, folder).groupBy("route").agg(
        F.count(F.lit(1)).alias("days"), F.avg("rides").alias("mean"), F.stddev_samp("rides").alias("deviation"), F.sum("rides").alias("rides")
    )
    return out.withColumn("variation", ratio(F.col("deviation"), F.col("mean"))).orderBy(F.desc("variation"), "route").limit(15)


@query(f"""SELECT kind, avg(rides) AS mean, median(rides) AS median, stddev_samp(rides) AS deviation, CAST(sum(rides) FILTER (isodow(service_date) < 6) AS BIGINT) AS weekday_rides FROM {_RIDES} WHERE kind IS NOT NULL GROUP BY 1""",
  ("mean", "median", "deviation"))
def day_kind_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rides(spark, folder).where("kind IS NOT NULL")
    middle = stats.percentiles(rows, ["kind"], "rides", [0.5]).select("kind", F.col("percentiles")[0].alias("median"))
    out = rows.groupBy("kind").agg(F.avg("rides").alias("mean"), F.stddev_samp("rides").alias("deviation"), F.sum(F.when(F.weekday("service_date") < 5, F.col("rides"))).alias("weekday_rides"))
    return out.join(middle, "kind")


_HOURS = "(SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS amount FROM events GROUP BY 1, 2)"


def _hours(spark, folder):
    e = table(spark, folder, "events")
    return e.groupBy(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("events"), F.sum(money("value", 18, 4)).cast("double").alias("amount"))


@query(f"""WITH d AS (SELECT day, CAST(sum(CAST(amount AS DECIMAL(18, 4))) AS DOUBLE) AS day_amount, CAST(sum(events) AS BIGINT) AS day_events FROM {_HOURS} GROUP BY 1)
  SELECT route, service_date, rides, h.events AS morning_events, h.amount AS morning_amount, day_amount, day_events FROM {_RIDES} r
    LEFT JOIN (SELECT * FROM {_HOURS} WHERE hour = 8) h ON h.day = service_date LEFT JOIN d ON d.day = service_date""")
def rides_with_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Readings with the value of one hour of their day and with the sum of all hours."""
    return series.with_hourly(_rides(spark, folder), "service_date", _hours(spark, folder), "day", "hour", 8, {"events": "morning_events", "amount": "morning_amount"}, {"amount": "day_amount", "events": "day_events"}).drop("kind")


@query(f"""WITH d AS (SELECT route, service_date, min(rides) AS rides FROM {_RIDES} GROUP BY 1, 2), s AS (SELECT route, CAST(unnest(generate_series(min(service_date), max(service_date), INTERVAL 1 DAY)) AS DATE) AS service_date FROM d GROUP BY 1),
  j AS (SELECT s.route, s.service_date, rides FROM s LEFT JOIN d USING (route, service_date))
  SELECT route, service_date, coalesce(last_value(rides IGNORE NULLS) OVER (PARTITION BY route ORDER BY service_date ROWS UNBOUNDED PRECEDING), first_value(rides IGNORE NULLS) OVER (PARTITION BY route ORDER BY service_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rides FROM j""")
def filled_series(spark: SparkSession, folder: str) -> DataFrame:
    """Every day of every route with its reading, the last one before it or the next one after it."""
    d = _rides(spark, folder).groupBy("route", "service_date").agg(F.min("rides").alias("rides"))
    days = series.calendar_days(d, ["route"], "service_date").join(d, ["route", "service_date"], "left")
    return series.filled(days, ["route"], "service_date", "rides").select("route", "service_date", "rides")


@query(f"""WITH q AS (SELECT route, quantile_cont(rides, 0.25) AS a, quantile_cont(rides, 0.75) AS b FROM {_RIDES} GROUP BY 1), n AS (SELECT route, service_date, count(*) AS n FROM {_RIDES} GROUP BY 1, 2)
  SELECT r.route, r.service_date, rides, rides < 0 AS negative, rides < a - 3 * (b - a) OR rides > b + 3 * (b - a) AS outlier, n.n > 1 AS ambiguous FROM {_RIDES} r JOIN q USING (route) JOIN n USING (route, service_date)
  WHERE rides < 0 OR rides < a - 3 * (b - a) OR rides > b + 3 * (b - a) OR n.n > 1""")
def reading_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that are negative, outside wide quartile fences or contradicted by another one of the day."""
    return Q.measurement_flags(_rides(spark, folder).drop("kind"), ["route"], "service_date", "rides", 3.0)


@query("""SELECT route, isodow(service_date) - 1 AS place, strftime(service_date, '%a') AS weekday, avg(rides) AS mean FROM (SELECT DISTINCT route, service_date, rides FROM cta_ridership_sample WHERE rides IS NOT NULL) GROUP BY 1, 2, 3""", ("mean",))
def weekday_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rides(spark, folder).groupBy("route", F.weekday("service_date").alias("place"), F.date_format("service_date", "E").alias("weekday")).agg(F.avg("rides").alias("mean"))
    return R.in_given_order(rows, "weekday", ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])


@query("""WITH d AS (SELECT DISTINCT service_date AS day FROM cta_ridership_sample WHERE service_date IS NOT NULL),
  x AS (SELECT day, month(day) AS m, dayofmonth(day) AS d, isodow(day) AS w FROM d)
  SELECT day FROM x WHERE (m, d) IN ((1, 1), (2, 12), (6, 19), (7, 4), (11, 11), (12, 25)) OR (w = 1 AND ((m IN (1, 2) AND d BETWEEN 15 AND 21) OR (m = 5 AND d >= 25) OR (m = 9 AND d <= 7) OR (m = 10 AND d BETWEEN 8 AND 14)))
    OR (w = 4 AND m = 11 AND d BETWEEN 22 AND 28)""")
def holidays(spark: SparkSession, folder: str) -> DataFrame:
    """Federal holidays, and those of the state of Illinois."""
    d = table(spark, folder, "cta_ridership_sample").select(F.col("service_date").alias("day")).where("day IS NOT NULL").distinct()
    return d.where(dates.us_federal_holiday(F.col("day")) | dates.state_holiday(F.col("day"), "IL"))


@query("""SELECT DISTINCT route, service_date, ingested_at, rides FROM (SELECT *, row_number() OVER (PARTITION BY route, service_date ORDER BY ingested_at DESC, rides DESC NULLS LAST) AS rn FROM cta_ridership_sample) WHERE rn = 1""")
def latest_by_composite_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cta_ridership_sample").select("route", "service_date", "ingested_at", "rides")
    return upsert.latest_per_key(rows, ["route", "service_date"], ["ingested_at"])


# Numbers and structures -------------------------------------------------------------------------
@query("""SELECT l_orderkey AS order_key, l_linenumber AS line, floor(l_extendedprice / 7 * 100 + 0.5) / 100 AS half_up, abs(l_discount - 0.05) AS off, least(100.0, l_quantity * 3) AS capped FROM lineitem""", ("off",))
def number_forms(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity") * 3
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), numbers.half_up(F.col("l_extendedprice") / 7, 2).alias("half_up"),
        F.abs(F.col("l_discount") - 0.05).alias("off"), numbers.clip(q, high=100.0).alias("capped"),
    )


@query("""SELECT l_partkey AS part, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1""")
def items_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """An array of objects in a text column, parsed by a stated schema and exploded."""
    packed = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q")))).alias("body"))
    items = packed.select(F.explode(F.from_json("body", "array<struct<part: bigint, q: double>>")).alias("x")).select("x.*")
    return items.groupBy("part").agg(F.count(F.lit(1)).alias("lines"), F.sum(money("q", 12, 2)).cast("double").alias("quantity"))


@query("""SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) > 100 AS is_busy FROM events GROUP BY 1, 2""")
def hours_from_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """A day as a struct of equally long arrays, turned into rows."""
    from millrace.sources.readers import parallel_arrays

    rows = F.array_sort(F.collect_list(F.struct("hour", "events", "amount")))
    days = _hours(spark, folder).groupBy("day").agg(rows.alias("r"))
    days = days.select("day", F.struct(F.col("r.hour").alias("hour"), F.col("r.events").alias("events"), F.col("r.amount").alias("amount")).alias("hourly"))
    return parallel_arrays(days, "hourly", ["hour", "events", "amount"]).select("day", "hour", "events", (F.col("amount") > 100).alias("is_busy"))


@query("""SELECT 'k' AS feature, count(*) AS n, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS mean FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL
  UNION ALL SELECT 'value', count(*), avg(value) FROM events WHERE value IS NOT NULL""", ("mean",))
def logged_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features in nested log records, one row per feature and record; what is no number is skipped."""
    e = table(spark, folder, "events").select(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("value").cast("string").alias("value")).alias("inputs"))
    return Q.feature_values(e, "inputs", ["k", "value"]).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("""SELECT id, loaded_at, rating.rate AS rate, rating.count AS count FROM products_sample WHERE rating IS NOT NULL""")
def ratings_from_text(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings written as the text of a dictionary with single quotes."""
    p = table(spark, folder, "products_sample").where("rating IS NOT NULL")
    words = F.concat(F.lit("{'rate': "), F.coalesce(F.col("rating.rate").cast("string"), F.lit("null")), F.lit(", 'count': "), F.coalesce(F.col("rating.count").cast("string"), F.lit("null")), F.lit("}"))
    return p.select("id", "loaded_at", text.relaxed_json(words, "rate double, count bigint").alias("r")).select("id", "loaded_at", "r.*")


@query("""SELECT user_id, coalesce(max(device) FILTER (device <> ''), 'unknown') AS device, coalesce(max(channel) FILTER (channel <> ''), 'direct') AS channel FROM events_sample WHERE user_id IS NOT NULL GROUP BY 1""")
def merged_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Defaults overwritten by what is known; NULL and blank values overwrite nothing."""
    e = table(spark, folder, "events_sample").where("user_id IS NOT NULL").groupBy("user_id").agg(
        F.max(F.when(F.col("device") != "", F.col("device"))).alias("device"), F.max(F.when(F.col("channel") != "", F.col("channel"))).alias("channel")
    )
    merged = numbers.merged_maps(F.create_map(F.lit("device"), F.lit("unknown"), F.lit("channel"), F.lit("direct")), F.create_map(F.lit("device"), F.col("device"), F.lit("channel"), F.col("channel")))
    return e.select("user_id", merged.alias("m")).select("user_id", F.col("m")["device"].alias("device"), F.col("m")["channel"].alias("channel"))


# Texts ------------------------------------------------------------------------------------------
STOPWORDS = ["the", "and", "for", "with", "that", "this", "was", "has", "have", "from", "are", "its"]
LEMMAS = {"drivers": "driver", "riders": "rider", "routes": "route", "maps": "map", "counted": "count", "closed": "close", "moved": "move"}
_S_WORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({}))".format(", ".join(f"'{w}'" for w in STOPWORDS))
_S_LEMMAS = "array_to_string(list_transform({}, lambda x: CASE x {} ELSE x END), ' ')".format(_S_WORDS, " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEMMAS.items()))


@query(f"SELECT doc_id, md5({_S_LEMMAS}) AS lemmas, length({_S_LEMMAS}) / nullif(length(text), 0) AS kept FROM documents", ("kept",))
def lemma_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without stopwords and short words, in base forms of a given table, and what share of their length is left."""
    d = table(spark, folder, "documents")
    found = text.lemmas(text.without_stopwords(F.col("text"), STOPWORDS), LEMMAS)
    return d.select("doc_id", F.md5(found).alias("lemmas"), ratio(F.length(found), F.length("text")).alias("kept"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\?')) AS questions, len(regexp_extract_all(text, '(?m)^[ ]*[0-9]+[.)] ')) AS steps, len(regexp_extract_all(text, '\[[0-9]+\]')) AS citations,
  TRY_CAST(nullif(regexp_extract(text, '([0-9]+) (minute|day|week|month)s?\b', 1), '') AS INTEGER) AS amount, nullif(regexp_extract(text, '([0-9]+) (minute|day|week|month)s?\b', 2), '') AS unit,
  CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS snippet FROM documents WHERE text IS NOT NULL""")
def text_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of questions, numbered steps and citations, the first duration and a snippet of every text."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    t = F.col("text")
    amount, unit = text.duration(t)
    return d.select(
        "doc_id", F.regexp_count(t, F.lit(r"\?")).alias("questions"), F.regexp_count(t, F.lit("(?m)^[ ]*[0-9]+[.)] ")).alias("steps"), F.regexp_count(t, F.lit(r"\[[0-9]+\]")).alias("citations"),
        amount.alias("amount"), unit.alias("unit"), text.snippet(t).alias("snippet"),
    )


@query("""WITH t AS (SELECT doc_id, left(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 180) AS k FROM documents WHERE text IS NOT NULL AND trim(text) <> ''),
  g AS (SELECT k, min(doc_id) AS first_key, count(*) AS copies FROM t GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, first_key, copies FROM t JOIN g USING (k)""")
def prefix_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that begin alike: texts whose first 180 plain characters agree."""
    d = table(spark, folder, "documents").where("text IS NOT NULL AND trim(text) <> ''")
    return R.near_copies(d, "doc_id", F.substring(text.plain(F.col("text")), 1, 180))


FOCUS = {"route": 2, "rider": 1, "refund": 2, "lost": -5}
_S_SCORE = " + ".join(f"CASE WHEN contains(lower(s), '{w}') THEN {v} ELSE 0 END" for w, v in FOCUS.items())


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
  q AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS pos FROM p), r AS (SELECT doc_id, s, pos, """ + _S_SCORE + """ AS score FROM q)
  SELECT doc_id, CAST(pos AS INTEGER) AS position, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM r WHERE score > 0) WHERE rn <= 3""")
def focus_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The three sentences of each text that score best by focus terms."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    rows = d.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("position", "s")).withColumn("score", text.term_score(F.col("s"), FOCUS)).where("score > 0")
    return rows.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "position"))), 1, 3).alias("b")).select("doc_id", F.explode("b").alias("x")).select(
        "doc_id", F.col("x.position").alias("position"), (-F.col("x.m")).alias("score")
    )


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '(?m)^(Labels|Tags|Source|Author|Date)\b.*$', '', 'g'), '(?m)^[-=*_]{3,}\s*$', '', 'g'))) AS body FROM documents WHERE text IS NOT NULL""")
def stripped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without lines of metadata and rules."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(text.without_metadata(F.col("text"), ["Labels", "Tags", "Source", "Author", "Date"])).alias("body"))


@query(r"""WITH u AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\s"''<>)\]]+')), '[.,;:!?]+$', '') AS url FROM documents),
  h AS (SELECT doc_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM u)
  SELECT host, count(*) AS links, count(DISTINCT doc_id) AS pages, max(trim(regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*(?:/[^?#]*)?/([^/?#]+)', 1), '\.[a-z]+$', ''), '[-_]+', ' ', 'g'))) AS label FROM h GROUP BY 1""")
def link_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Links by host, with a label made from the address where the page gives none."""
    links = table(spark, folder, "documents").select("doc_id", F.explode(text.urls(F.col("text"))).alias("url"))
    return links.groupBy(text.link_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("doc_id").alias("pages"), F.max(text.link_label(F.col("url"))).alias("label"))


_S_OUT = """CASE WHEN user_id % 5 = 0 THEN 'Sure! ' || chr(96) || chr(96) || chr(96) || 'json {"score": ' || (user_id % 14) || ', "sector": "s' || (user_id % 3) || '"} done' WHEN user_id % 5 = 1 THEN 'no json' WHEN user_id % 5 = 2 THEN '{"score": "x", "sector": ""}' ELSE '{"score": ' || (user_id % 9 + 1) || ', "sector": "Health"}' END"""


@query("""WITH u AS (SELECT DISTINCT user_id FROM events)
  SELECT user_id, CASE WHEN user_id % 5 = 0 THEN user_id % 14 BETWEEN 1 AND 10 WHEN user_id % 5 IN (1, 2) THEN false ELSE true END AS success,
    CASE WHEN user_id % 5 = 0 AND NOT (user_id % 14 BETWEEN 1 AND 10) THEN 'score: out of range' WHEN user_id % 5 = 1 THEN 'no object' WHEN user_id % 5 = 2 THEN 'score: missing; sector: empty' END AS error FROM u""")
def model_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a model checked against a contract; a bad one gives the reason and never an error."""
    fence = "`" * 3
    k = F.col("user_id")
    said = F.when(k % 5 == 0, F.concat(F.lit(f"Sure! {fence}json {{\"score\": "), k % 14, F.lit(', "sector": "s'), k % 3, F.lit('"} done'))).when(k % 5 == 1, "no json")
    said = said.when(k % 5 == 2, '{"score": "x", "sector": ""}').otherwise(F.concat(F.lit('{"score": '), k % 9 + 1, F.lit(', "sector": "Health"}')))
    rows = table(spark, folder, "events").select("user_id").distinct().withColumn("said", said)
    checked = Q.checked_object(F.col("said"), "score int, sector string", [
        ("score: missing", lambda o: o["score"].isNotNull()), ("score: out of range", lambda o: o["score"].isNull() | o["score"].between(1, 10)), ("sector: empty", lambda o: F.coalesce(F.trim(o["sector"]), F.lit("")) != ""),
    ])
    return rows.select("user_id", checked.alias("c")).select("user_id", "c.success", "c.error")


@query("""WITH q AS (SELECT user_id, 'is it ' || CASE WHEN user_id % 3 = 0 THEN 'yes' WHEN user_id % 3 = 1 THEN 'no' ELSE 'maybe' END || ', about ' || user_id || ' of ' || CASE WHEN user_id % 2 = 0 THEN 'f-1' ELSE 'J1 visa' END AS t FROM (SELECT DISTINCT user_id FROM events))
  SELECT user_id, CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 3 = 1 THEN false END AS truth, CAST(user_id AS INTEGER) AS number, CASE WHEN user_id % 2 = 0 THEN 'F-1' ELSE 'J-1' END AS kind FROM q""")
def parsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Yes or no, a number and one of a list of values, read from free text."""
    k = F.col("user_id")
    said = F.concat(F.lit("is it "), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("maybe"), F.lit(", about "), k, F.lit(" of "), F.when(k % 2 == 0, "f-1").otherwise("J1 visa"))
    rows = table(spark, folder, "events").select("user_id").distinct().withColumn("t", said)
    return rows.select("user_id", text.truth(F.col("t")).alias("truth"), text.first_int(F.col("t")).alias("number"), text.one_of(F.col("t"), {"F-1": r"f-?1", "J-1": r"j-?1"}).alias("kind"))


@query(r"""WITH d AS (SELECT doc_id, 'Title: ' || coalesce(source, '') || chr(10) || 'Url: https://' || site || page_path || chr(10) || coalesce(text, '') AS t, source, site FROM documents)
  SELECT doc_id, coalesce(source, site) AS title, site AS host FROM d""")
def document_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of a document's head with fallbacks."""
    d = table(spark, folder, "documents")
    t = F.concat(F.lit("Title: "), F.coalesce("source", F.lit("")), F.lit("\nUrl: https://"), F.col("site"), F.col("page_path"), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = d.select("doc_id", "site", t.alias("t"))
    host = F.regexp_extract(text.metadata_line(F.col("t"), "Url"), r"^https://([^/]+)", 1)
    return rows.select("doc_id", F.coalesce(text.metadata_line(F.col("t"), "Title"), "site").alias("title"), host.alias("host"))


# Retrieval --------------------------------------------------------------------------------------
SECTIONS = (
    ("apply|application", "application"), ("fee|price|cost", "fees"), ("visa|permit", "visa"), ("deadline|due", "deadlines"), ("course|credit", "courses"), ("refund|return", "returns"),
    ("route|stop|bus", "transit"), ("investor|round", "funding"), ("patient|doctor|stay", "care"), ("contact|phone", "contact"),
)


@query("SELECT section, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN '{t}'" for p, t in SECTIONS) + " ELSE 'general' END AS section FROM documents) GROUP BY 1")
def section_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Eleven labels by keywords in order."""
    return table(spark, folder, "documents").groupBy(retrieval.classify(F.col("text"), SECTIONS, "general").alias("section")).agg(F.count(F.lit(1)).alias("n"))


_HITS = """(SELECT c_custkey % 40 AS query_id, c_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS position, c_mktsegment AS text, c_acctbal AS score FROM customer)"""


def _hits(spark, folder):
    c = table(spark, folder, "customer").select((F.col("c_custkey") % 40).alias("query_id"), F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("text"), F.col("c_acctbal").alias("score"))
    return c.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


@query(f"""WITH h AS (SELECT * FROM {_HITS}), a AS (SELECT query_id, doc_id, position FROM h), b AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS position FROM h),
  s AS (SELECT query_id, doc_id, sum(1.0 / (60 + position)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
  SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rn FROM s) WHERE rn <= 5""", ("score",))
def fused_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Two rankings of the same documents fused by reciprocal ranks."""
    h = _hits(spark, folder)
    other = h.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    fused = retrieval.reciprocal_rank_fusion([h, other], "doc_id", k=5)
    return fused.select("query_id", "doc_id", "score")


@query(f"""WITH b AS (SELECT *, score + CASE WHEN contains(lower(text), 'build') THEN 500 ELSE 0 END + CASE WHEN contains(lower(text), 'auto') THEN -800 ELSE 0 END AS s FROM {_HITS})
  SELECT query_id, doc_id, CAST(rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rn FROM b) WHERE rn <= 5""")
def reranked_hits(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.rerank(_hits(spark, folder), F.col("text"), [("build", 500.0), ("auto", -800.0)], 5)
    return found.select("query_id", "doc_id", "position")


@query(f"""WITH h AS (SELECT *, text = 'BUILDING' AS fits FROM {_HITS}), n AS (SELECT query_id, count_if(fits AND position <= 20) AS n FROM h GROUP BY 1),
  k AS (SELECT h.* FROM h JOIN n USING (query_id) WHERE fits OR n = 0), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rn, score, max(score) OVER (PARTITION BY query_id) AS best FROM k WHERE position <= 20)
  SELECT query_id, doc_id, CAST(rn AS INTEGER) AS position FROM r WHERE rn <= CASE WHEN best >= 9800 THEN 3 ELSE 6 END""")
def filtered_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the wanted topic, all hits where a query has none of it; fewer where the best one is a clear one."""
    hits = _hits(spark, folder).where("position <= 20")
    return retrieval.with_fallback(hits, F.col("text") == "BUILDING", F.when(F.col("best") >= 9800, 3).otherwise(6)).select("query_id", "doc_id", "position")


@query(f"""WITH h AS (SELECT query_id, doc_id, position, 0 AS l FROM {_HITS} WHERE position <= 6 UNION ALL SELECT query_id, doc_id, position, 1 FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS position FROM {_HITS}) WHERE position <= 6),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY l, position) AS n FROM h)
  SELECT query_id, doc_id, CAST(rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l, position) AS rn FROM o WHERE n = 1) WHERE rn <= 8""")
def merged_hits(spark: SparkSession, folder: str) -> DataFrame:
    h = _hits(spark, folder).select("query_id", "doc_id", "position")
    other = h.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return retrieval.merge_lists([h.where("position <= 6"), other.where("position <= 6")], ["doc_id"], ["query_id"], 8).select("query_id", "doc_id", "position")


# Contracts --------------------------------------------------------------------------------------
@query("""SELECT 'cart_id: missing' AS rule, count_if(cart_id IS NULL) AS rows FROM orders_sample UNION ALL SELECT 'order_value: out of range', count_if(order_value IS NOT NULL AND NOT order_value BETWEEN 0 AND 5000) FROM orders_sample
  UNION ALL SELECT 'item_count: not positive', count_if(item_count <= 0) FROM orders_sample UNION ALL SELECT 'user_id: missing', count_if(user_id IS NULL) FROM orders_sample""")
def cart_contract(spark: SparkSession, folder: str) -> DataFrame:
    rules = [Q.required("cart_id"), Q.between("order_value", 0, 5000), Q.positive("item_count"), Q.required("user_id")]
    return Q.violations(Q.require_columns(table(spark, folder, "orders_sample"), ["cart_id", "user_id"]), rules)


@query("""SELECT event_id, concat_ws('; ', CASE WHEN NOT regexp_matches(event_type, '^[a-z_]+$') THEN 'event_type: bad format' END, CASE WHEN user_id IS NULL THEN 'user_id: missing' END,
  CASE WHEN device IS NOT NULL AND device NOT IN ('mobile', 'desktop', 'tablet') THEN 'device: unknown value' END) AS validation_errors FROM (SELECT DISTINCT event_id, event_type, user_id, device FROM events_sample)
  WHERE NOT regexp_matches(event_type, '^[a-z_]+$') OR user_id IS NULL OR (device IS NOT NULL AND device NOT IN ('mobile', 'desktop', 'tablet'))""")
def event_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events_sample").select("event_id", "event_type", "user_id", "device").distinct()
    rules = [Q.matching("event_type", "^[a-z_]+$"), Q.required("user_id"), Q.one_of("device", ["mobile", "desktop", "tablet"])]
    return Q.split(rows, rules)[1].select("event_id", "validation_errors")


@query("SELECT id, loaded_at FROM products_sample WHERE price > 0 AND description IS NULL")
def priced_without_text(spark: SparkSession, folder: str) -> DataFrame:
    return Q.conditional_nulls(table(spark, folder, "products_sample"), F.col("price") > 0, "description").select("id", "loaded_at")


@query("SELECT count(*) AS rows, count_if(json_extract_string(props, '$.k') IS NOT NULL) AS with_k FROM events")
def json_contract(spark: SparkSession, folder: str) -> DataFrame:
    """A schema of JSON objects compiled into rules: required and typed fields, no additional ones."""
    rules = Q.json_schema("props", {"k": "int"}, required=["k"], additional=False)
    checked = Q.validate(table(spark, folder, "events"), rules)
    return checked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("validation_errors") == 0).alias("with_k"))


# Learning ---------------------------------------------------------------------------------------
@query("SELECT o_orderstatus = 'F' AS label, count(*) * CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END AS rows FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
def oversampled(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").where("o_orderstatus IN ('F', 'O')").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("label"))
    return learning.synthetic_minority(o, "o_orderkey", ["o_totalprice", "day"], "label", True, 2).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT c_custkey AS customer, CASE WHEN abs(2.0 * c_acctbal) >= abs(-3.0 * c_nationkey) THEN 'balance' ELSE 'nation' END AS feature FROM customer""")
def score_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """What moves a linear score of each customer most."""
    c = table(spark, folder, "customer")
    rows = c.select(F.col("c_custkey").alias("customer"), learning.array_to_vector(F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double"))).alias("features"))
    told = learning.contributions(rows, [2.0, -3.0], ["balance", "nation"], most=1)
    return told.select("customer", F.col("contributions")[0]["feature"].alias("feature"))


@query("""SELECT c_custkey AS customer, 'c_acctbal' AS feature, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey FROM customer""")
def important_values(spark: SparkSession, folder: str) -> DataFrame:
    """The important features with each row's own value."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("customer"), "c_acctbal", "c_nationkey")
    found = spark.createDataFrame([("c_acctbal", 0.7), ("c_nationkey", 0.3)], "feature string, importance double")
    return learning.with_own_values(c, found).select("customer", "feature", "value")


@query()
def route_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """A forecast with band for every route, fitted on weather and holidays beside trend and season."""
    rows = table(spark, folder, "cta_ridership_sample").groupBy("route", "service_date").agg(F.max("rides").alias("rides"), F.max("precipitation").alias("rain"), F.max("temperature_2m").alias("warmth"))
    rows = rows.withColumn("holiday", dates.us_federal_holiday(F.col("service_date")).cast("double"))
    return learning.series_forecast(rows, "route", "service_date", "rides", "2023-12-31", 28, ["rain", "warmth"], "holiday")


@query("""SELECT user_id, 'answer ' || user_id AS answer, CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 2 END AS INTEGER) AS links, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'https://www.city.example/b' ELSE 'https://other.example/a' END AS best
  FROM (SELECT DISTINCT user_id FROM events)""")
def answers_with_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Answers split at their sources, and the source of a preferred host."""
    k = F.col("user_id")
    links = F.when(k % 3 == 1, " Sources: https://other.example/a, https://www.city.example/b. https://other.example/a").when(k % 3 == 2, " Sources: https://other.example/a https://x.example").otherwise("")
    rows = table(spark, folder, "events").select("user_id").distinct().withColumn("t", F.concat(F.lit("answer "), k, links))
    before, found = text.answer_and_sources(F.col("t"))
    return rows.select("user_id", before.alias("answer"), F.size(found).alias("links"), text.preferred(found, "city.example").alias("best"))


@query("SELECT count(*) AS rows, 0 AS differing FROM orders")
def stored_model(spark: SparkSession, folder: str) -> DataFrame:
    """A fitted pipeline saved, loaded and applied: rows that it scores otherwise than before."""
    from millrace.runtime import scratch

    rows = table(spark, folder, "orders").select("o_orderkey", F.array(F.col("o_totalprice") / 1e5, (F.col("o_custkey") % 7).cast("double")).alias("x"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    rows = rows.select("o_orderkey", learning.array_to_vector("x").alias("features"), "label")
    model = learning.Pipeline(stages=[learning.LogisticRegression(maxIter=5)]).fit(rows)
    path = scratch(spark, "model")
    learning.save(model, path)
    a = learning.probability(model, rows).select("o_orderkey", F.col("score").alias("a"))
    b = learning.probability(learning.load(path), rows).select("o_orderkey", F.col("score").alias("b"))
    return a.join(b, "o_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).cast("int").alias("differing"))


@query()
def vector_index_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th vector asked of an index of all vectors."""
    e = table(spark, folder, "embeddings")
    found = retrieval.VectorIndex(e, "vec_id", "embedding").search(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "key", "position")


@query()
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th document asked of all documents: words and vectors fused, reranked, held to the topic where there are hits of it."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    asked = docs.where("doc_id % 50 = 0")
    v = cut(learning.text_vectors(docs, "text").select("doc_id", "vector")).where("vector IS NOT NULL")  # else projected again for every block
    near = retrieval.cosine_top_k(v, "doc_id", "vector", v.where("doc_id % 50 = 0"), "doc_id", "vector", 20).withColumnRenamed("key", "doc_id")
    lexical = retrieval.bm25(docs, "doc_id", {"text": 1.0}, asked, "doc_id", "text", 20)
    found = retrieval.hybrid([lexical, near], docs, "doc_id", "text", [("notice", 0.01), ("spam", -0.01)], F.col("source").isin("help_center", "policy_pages"), 5)
    return found.select("query_id", "doc_id", "position")


@query()
def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks merged by content into a table; sending them again changes nothing."""
    from millrace.runtime import scratch
    from millrace.sources.tables import VersionedTable

    chunks = retrieval.chunk(table(spark, folder, "documents"), "doc_id", "text").select("chunk_id", "doc_id", "chunk_no", "words")
    stored = VersionedTable(spark, scratch(spark, "chunks"), buckets=8)
    for _ in range(2):
        stored.upsert(chunks.dropDuplicates(["chunk_id"]), ["chunk_id"])
    return stored.read()


@query()
def token_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in windows of 380 tokens of a public vocabulary."""
    from millrace.functions.encoding import VOCABULARY

    found = retrieval.chunk(table(spark, folder, "documents"), "doc_id", "text", vocabulary=VOCABULARY)
    return found.select("doc_id", "chunk_no", "heading", F.col("words").alias("tokens"), "chunk_id")


# Dashboards -------------------------------------------------------------------------------------
_STARTUPS = """(SELECT DISTINCT id, lower(trim(sector)) AS sector, lower(trim(stage)) AS stage, hq_country AS country, funding_year AS year, revenue_stage, funding_amount_usd AS amount, name, description FROM startups_sample)"""


def _startups(spark, folder):
    return table(spark, folder, "startups_sample").select(
        "id", F.lower(F.trim("sector")).alias("sector"), F.lower(F.trim("stage")).alias("stage"), F.col("hq_country").alias("country"), F.col("funding_year").alias("year"),
        "revenue_stage", F.col("funding_amount_usd").alias("amount"), "name", "description",
    ).distinct()


@query(f"""SELECT sector, stage, country, year, revenue_stage, count(*) AS startups, count(*) FILTER (amount >= 10000000) AS large, 100.0 * (count(*) FILTER (amount >= 10000000) / count(*)) AS pct FROM {_STARTUPS} GROUP BY 1, 2, 3, 4, 5""", ("pct",))
def startup_matrix(spark: SparkSession, folder: str) -> DataFrame:
    out = _startups(spark, folder).groupBy("sector", "stage", "country", "year", "revenue_stage").agg(F.count(F.lit(1)).alias("startups"), F.count_if(F.col("amount") >= 10_000_000).alias("large"))
    return out.withColumn("pct", 100.0 * ratio(F.col("large"), F.col("startups")))


@query(f"""SELECT stage, count(*) AS startups, count(DISTINCT sector) AS sectors, count(DISTINCT country) AS countries, median(amount) AS median_amount FROM {_STARTUPS} WHERE stage IS NOT NULL AND amount > 0 GROUP BY 1""")
def stage_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    rows = _startups(spark, folder).where("stage IS NOT NULL AND amount > 0")
    middle = stats.percentiles(rows, ["stage"], "amount", [0.5]).select("stage", F.col("percentiles")[0].alias("median_amount"))
    out = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("startups"), F.count_distinct("sector").alias("sectors"), F.count_distinct("country").alias("countries"))
    return out.join(middle, "stage")


@query(f"SELECT id, md5(concat_ws(' ', name, description, sector)) AS text FROM {_STARTUPS}")
def joined_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Fields joined by a space; NULL fields are left out."""
    return _startups(spark, folder).select("id", F.md5(F.concat_ws(" ", "name", "description", "sector")).alias("text"))


@query("""SELECT 'top_k: out of range' AS rule, count_if(NOT o_orderkey % 25 BETWEEN 1 AND 20) AS rows FROM orders UNION ALL SELECT 'o_orderpriority: bad length', count_if(NOT length(o_orderpriority) BETWEEN 5 AND 10) FROM orders
  UNION ALL SELECT 'o_orderstatus: unknown value', count_if(o_orderstatus NOT IN ('F', 'O')) FROM orders""")
def request_bounds(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "orders").withColumn("top_k", F.col("o_orderkey") % 25)
    return Q.violations(asked, [Q.between("top_k", 1, 20), Q.length_between("o_orderpriority", 5, 10), Q.one_of("o_orderstatus", ["F", "O"])])
