"""Readers, writers, versioned tables and streams as queries: each writes to the shared folder and reads back what it wrote."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import money
from millrace.plans import analytics
from millrace.operators import quality as Q
from millrace.operators.reports import in_given_order
from millrace.runtime import scratch, table
from millrace.sources import readers, tables
from millrace.streaming import pipeline

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


# Readers ----------------------------------------------------------------------------------------
@query("""SELECT c_nationkey AS nation, count(*) AS customers, count(c_mktsegment) FILTER (c_custkey % 10 <> 0) AS known, CAST(sum(CAST(c_acctbal AS DECIMAL(12, 2))) AS DOUBLE) AS balance FROM customer GROUP BY 1""")
def csv_with_null_token(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV file with a header, a stated schema and "?" for what is not known."""
    path = scratch(spark, "csv")
    c = table(spark, folder, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")))
    c.write.mode("overwrite").option("header", "true").option("nullValue", "?").csv(path)
    got = readers.csv(spark, path, c.schema.simpleString()[7:-1].replace(":", " "), "?")
    return got.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("customers"), F.count("c_mktsegment").alias("known"), F.sum(money("c_acctbal", 12, 2)).cast("double").alias("balance")
    )


@query("""SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def csv_coerced(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV file whose bad numbers and dates become NULL."""
    path = scratch(spark, "csv")
    k = F.col("o_orderkey")
    o = table(spark, folder, "orders").select(
        k.alias("order_key"), F.when(k % 17 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 19 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    o.write.mode("overwrite").option("header", "true").csv(path)
    return readers.csv_coerced(spark, path, {"order_key": "bigint", "price": "double", "day": "date"})


@query("SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY 1")
def parquet_or_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The Parquet copy if there is one, else the CSV copy."""
    path = scratch(spark, "either")
    n = table(spark, folder, "nation")
    n.write.mode("overwrite").option("header", "true").csv(f"{path}/n.csv")
    got = readers.first_available(spark, [(f"{path}/n.parquet", spark.read.parquet), (f"{path}/n.csv", lambda p: readers.csv(spark, p, "n_nationkey int, n_name string, n_regionkey int"))])
    return got.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("nations"))


@query("SELECT r_regionkey AS region, r_name AS name FROM region")
def feed_or_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A feed that fails for whatever reason is replaced by the sample file."""
    path = scratch(spark, "feed")
    table(spark, folder, "region").write.mode("overwrite").json(f"{path}/feed")
    broken = lambda: spark.read.parquet(f"{path}/feed")
    return readers.first_working([broken, lambda: table(spark, folder, "region")]).select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def catalog_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A table created in the catalog, scanned with projection, lower date and list of keys pushed down."""
    path, o = scratch(spark, "catalog"), table(spark, folder, "orders")
    name = "orders_" + path.rsplit("-", 1)[-1]
    o.write.mode("overwrite").parquet(path)
    tables.create_tables(spark, {name: (o.schema.simpleString()[7:-1].replace(":", " "), path)})
    return readers.catalog(spark, name, ["o_orderkey", "o_orderpriority", "o_totalprice"], ("o_orderdate", "1998-01-01"), ("o_orderpriority", ["1-URGENT", "5-LOW"]))


def _service_file(spark, folder, columns):
    """The readings as one file of JSON lines, the stand-in for a paged service, and its path as tasks open it."""
    path = scratch(spark, "service")
    rows = table(spark, folder, "cta_ridership_sample").where("route IS NOT NULL").select(*columns)
    rows.coalesce(1).write.mode("overwrite").json(path)
    name = readers.listing(spark, path, "*.json").first().path
    readers.register(spark)
    return name.removeprefix("file:").replace("///", "/")


@query("SELECT route, CAST(service_date AS VARCHAR) AS service_date, rides FROM cta_ridership_sample WHERE route IN ('1', '11') AND service_date BETWEEN DATE '2023-06-01' AND DATE '2023-08-31'")
def paged_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a service with route list and date range pushed into its requests."""
    path = _service_file(spark, folder, ["route", F.date_format("service_date", "yyyy-MM-dd").alias("service_date"), "rides"])
    pages = spark.read.format("paged").option("path", path).option("pagesize", "500").option("schema", "service_date string, route string, rides bigint").load()
    return pages.where(F.col("route").isin("1", "11") & (F.col("service_date") >= "2023-06-01") & (F.col("service_date") <= "2023-08-31"))


@query("SELECT DISTINCT route FROM cta_ridership_sample WHERE route IS NOT NULL")
def remote_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct routes as the service groups them, page by page."""
    return readers.remote_distinct(spark, _service_file(spark, folder, ["route"]), "route")


@query("""SELECT strftime(CAST(order_date AS DATE), '%Y-%m-%d') AS dt, count(*) AS carts, CAST(sum(item_count) AS BIGINT) AS items FROM orders_sample WHERE order_date >= TIMESTAMP '2024-02-01' GROUP BY 1""")
def json_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Compressed JSON below ``dt=`` folders; a filter on the day reads those folders only."""
    path = scratch(spark, "by_day")
    o = table(spark, folder, "orders_sample").where("order_date IS NOT NULL").withColumn("dt", F.date_format("order_date", "yyyy-MM-dd"))
    tables.write_json_by_key(o.select("cart_id", "item_count", "dt"), path, ["dt"])
    got = readers.partitioned_json(spark, path, "cart_id bigint, item_count int, dt string", lines=True)
    return got.where(F.col("dt") >= "2024-02-01").groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("carts"), F.sum("item_count").alias("items"))


@query("SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 9 <> 0")
def json_lines_skipping_bad(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of which some are blank or cut off."""
    path, k = scratch(spark, "lines"), F.col("s_suppkey")
    line = F.to_json(F.struct(k.alias("k"), F.col("s_acctbal").alias("v")))
    bad = F.when(k % 2 == 0, "").otherwise(F.substring(line, 1, 8))
    table(spark, folder, "supplier").select(F.when(k % 9 == 0, bad).otherwise(line).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    return readers.jsonl(spark, path, "k bigint, v double")


@query("SELECT count_if(s_suppkey % 9 <> 0) AS good, count_if(s_suppkey % 9 = 0) AS broken FROM supplier")
def json_lines_with_rejects(spark: SparkSession, folder: str) -> DataFrame:
    path, k = scratch(spark, "lines"), F.col("s_suppkey")
    line = F.to_json(F.struct(k.alias("k")))
    table(spark, folder, "supplier").select(F.when(k % 9 == 0, F.substring(line, 1, 4)).otherwise(line).alias("value")).write.mode("overwrite").text(path)
    good, bad = readers.jsonl_with_rejects(spark, path, "k bigint")
    return good.agg(F.count(F.lit(1)).alias("good")).join(bad.agg(F.count(F.lit(1)).alias("broken")))


@query("SELECT n_name AS name, n_nationkey % 4 = 0 AS changed FROM nation")
def changed_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text files below a folder, and which of them changed since the last manifest of hashes."""
    path = scratch(spark, "texts")
    n = table(spark, folder, "nation").withColumn("body", F.concat(F.lit("# "), "n_name"))
    n.select("body", F.col("n_name").alias("file")).repartition("file").write.mode("overwrite").partitionBy("file").text(path)
    found = readers.text_documents(spark, path, "*.txt").withColumn("name", F.regexp_extract("path", "file=([^/]+)/", 1))
    old = found.join(n.select(F.col("n_name").alias("name"), "n_nationkey"), "name")
    manifest = old.select("path", F.when(F.col("n_nationkey") % 4 == 0, "old").otherwise(F.col("sha256")).alias("sha256"))
    new = readers.changed_files(found, manifest).select("name").withColumn("changed", F.lit(True))
    return found.select("name").join(new, "name", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


@query("SELECT n_regionkey AS region, count(*) AS files FROM nation GROUP BY 1")
def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files by folder, without reading them."""
    path = scratch(spark, "listing")
    table(spark, folder, "nation").repartition("n_regionkey", "n_nationkey").write.mode("overwrite").partitionBy("n_regionkey", "n_nationkey").json(path)
    found = readers.listing(spark, path, "*.json")
    return found.groupBy(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("region")).agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT route, count(*) AS readings FROM cta_ridership_sample WHERE service_date BETWEEN DATE '2023-12-04' AND DATE '2023-12-31' GROUP BY 1""")
def readings_of_last_days(spark: SparkSession, folder: str) -> DataFrame:
    last = readers.last_days(table(spark, folder, "cta_ridership_sample"), "service_date", 28, "2023-12-31")
    return last.groupBy("route").agg(F.count(F.lit(1)).alias("readings"))


RULES = [
    {"name": "large", "field": "o_totalprice", "op": "ge", "value": 150_000}, {"name": "urgent", "field": "o_orderpriority", "op": "in", "value": ["1-URGENT", "2-HIGH"]},
    {"name": "open", "field": "o_orderstatus", "op": "ne", "value": "F"},
]


@query("""SELECT (CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END) + (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) + (CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS met, count(*) AS orders FROM orders GROUP BY 1""")
def judged_by_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions kept in a file, held against every row."""
    path = scratch(spark, "rules")
    spark.createDataFrame([(json.dumps(RULES),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    told = table(spark, folder, "orders").select(Q.judge(readers.rules(spark, path)).alias("j"))
    return told.groupBy(F.size("j.met").alias("met")).agg(F.count(F.lit(1)).alias("orders"))


# Tables -----------------------------------------------------------------------------------------
@query("""SELECT 1 AS version, 'overwrite' AS operation, count(*) AS rows FROM supplier UNION ALL SELECT 2, 'append', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0)
  UNION ALL SELECT 3, 'overwrite', count(*) FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 4, 'upsert', (SELECT count(*) FROM supplier WHERE s_acctbal > 0) + (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0 AND s_acctbal <= 0)
  UNION ALL SELECT 5, 'restore', count(*) FROM supplier""")
def table_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every version of a table that was overwritten, appended to, merged into and restored."""
    s = table(spark, folder, "supplier")
    some = s.where("s_suppkey % 5 = 0").withColumn("note", F.lit("again"))
    t = tables.VersionedTable(spark, scratch(spark, "versions"))
    t.overwrite(s)
    t.append(some)
    t.overwrite(s.where("s_acctbal > 0"))
    t.upsert(some, ["s_suppkey"])
    t.restore(1)
    return tables.version_counts(t)


@query("""SELECT route, service_date, rides FROM (SELECT *, row_number() OVER (PARTITION BY route, service_date ORDER BY ingested_at DESC, rides DESC NULLS LAST) AS rn FROM cta_ridership_sample WHERE route IS NOT NULL AND service_date IS NOT NULL) WHERE rn = 1""")
def late_deliveries_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Batches merged by a composite key into buckets; late ones of older versions change nothing, a repeated one neither."""
    c = table(spark, folder, "cta_ridership_sample").where("route IS NOT NULL AND service_date IS NOT NULL").select("route", "service_date", "ingested_at", "rides")
    t = tables.VersionedTable(spark, scratch(spark, "merged"), buckets=8)
    late = F.datediff("ingested_at", "service_date") > 3
    for batch in (c.where(late), c.where(~late), c.where(late)):
        t.upsert(batch, ["route", "service_date"], ["ingested_at"])
    return t.read().select("route", "service_date", "rides")


@query("SELECT o_orderpriority AS priority, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def view_over_table(spark: SparkSession, folder: str) -> DataFrame:
    """A layer as a view, the next one written as a table and registered as what was written."""
    path = scratch(spark, "layers")
    name = path.rsplit("-", 1)[-1]
    tables.create_view(table(spark, folder, "orders").where("o_orderstatus = 'F'"), f"closed_{name}")
    mart = spark.sql(f"SELECT o_orderpriority AS priority, count(*) AS orders FROM closed_{name} GROUP BY 1")
    return tables.create_view(mart, f"mart_{name}", tables.VersionedTable(spark, path))


@query("SELECT 'nation' AS \"table\", count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def export_report(spark: SparkSession, folder: str) -> DataFrame:
    """Tables exported as CSV, with the rows counted while writing."""
    return tables.export({n: table(spark, folder, n) for n in ("nation", "region", "supplier")}, scratch(spark, "export"))


@query("""SELECT CAST(ts AS DATE) AS log_date, count(*) AS n, max(ts) AS newest FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1""")
def daily_log(spark: SparkSession, folder: str) -> DataFrame:
    """A log by day to which two writers append."""
    path, e = scratch(spark, "log"), table(spark, folder, "events").select("event_id", "event_type", F.col("ts").alias("at"))
    for kind in ("error", "purchase"):
        tables.append_log(e.where(F.col("event_type") == kind), path, "at")
    got = spark.read.schema("event_id bigint, event_type string, at timestamp_ntz, log_date date").json(path)
    return got.groupBy("log_date").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("newest"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id LIMIT 50")
def newest_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Notes written as files and read back, newest first."""
    path, e = scratch(spark, "feedback"), table(spark, folder, "events").where("event_type = 'signup'").select("event_id", "user_id", "ts")
    tables.append_log(e, path, "ts")
    got = spark.read.schema("event_id bigint, user_id bigint, ts timestamp_ntz").json(path)
    return got.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "ts")


@query("""SELECT 'good' AS part, count(*) AS rows FROM orders_sample WHERE user_id IS NOT NULL AND order_value >= 0 UNION ALL SELECT 'dead', count(*) FROM orders_sample WHERE NOT coalesce(user_id IS NOT NULL AND order_value >= 0, false)""")
def dead_letter_twin(spark: SparkSession, folder: str) -> DataFrame:
    """Valid rows in one folder, rejected rows with their reasons in its twin."""
    good, bad = Q.split(table(spark, folder, "orders_sample"), [Q.required("user_id"), Q.required("order_value"), Q.between("order_value", 0, 1e12)])
    path, dead = tables.dead_letters(scratch(spark, "routed"), ["source"], ["shop"])
    tables.write_split(good, bad, path, dead)
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows")
    return count(spark.read.parquet(path), "good").unionByName(count(spark.read.schema("cart_id bigint, validation_errors string").json(dead), "dead"))


# Streams ----------------------------------------------------------------------------------------
_STREAM = "event_id bigint, user_id bigint, event_type string, value double, at timestamp"


def _messages(spark, folder):
    """The events as files of JSON lines, a part of them delivered twice and some cut off."""
    path = scratch(spark, "messages")
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    line = F.to_json(F.struct("*"))
    lines = e.select("event_id", line.alias("value"))
    again = lines.where("event_id % 10 = 0")
    cut_off = lines.where("event_id % 50 = 1").withColumn("value", F.substring("value", 1, 20))
    lines.unionByName(again).unionByName(cut_off).select("value").repartition(4).write.mode("overwrite").text(path)
    return path


def _streamed(spark, folder):
    good, bad = pipeline.decode(pipeline.json_stream(spark, _messages(spark, folder), 2), _STREAM)
    rules = [Q.required("user_id"), Q.between("value", 0, 1e9), Q.one_of("event_type", ["view", "click", "signup", "purchase"])]
    out = Q.validate(good, rules).withColumn("is_valid", F.size("validation_errors") == 0)
    return out, bad


@query("""SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS value FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') AND value >= 0 GROUP BY 1""")
def streamed_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of messages decoded, validated and merged by id; messages delivered twice count once."""
    at = scratch(spark, "stream")
    stored = tables.VersionedTable(spark, f"{at}/table")
    pipeline.drain(pipeline.upsert_sink(_streamed(spark, folder)[0], stored, ["event_id"], ["at"], f"{at}/checkpoint", f"{at}/dead"))
    return stored.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.sum(money("value", 18, 4)).cast("double").alias("value"))


@query("""WITH m AS (SELECT event_type IN ('view', 'click', 'signup', 'purchase') AND value >= 0 AS ok, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS n FROM events)
  SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (ok) AS BIGINT) AS valid, CAST(sum(n) FILTER (NOT ok) AS BIGINT) AS rejected FROM m""")
def streamed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, valid and rejected ones, as the batches of the stream counted them."""
    at = scratch(spark, "stream")
    stored = tables.VersionedTable(spark, f"{at}/table", buckets=4)
    pipeline.drain(pipeline.upsert_sink(_streamed(spark, folder)[0], stored, ["event_id"], ["at"], f"{at}/checkpoint", f"{at}/dead"))
    counted = spark.read.schema("rows bigint, valid bigint, rejected bigint").json(f"{at}/dead_counts")
    return counted.agg(*[F.sum(c).alias(c) for c in ("rows", "valid", "rejected")])


@query("SELECT event_type, count(*) AS rows, count_if(value >= 10) AS valid, count_if(NOT value >= 10) AS rejected FROM events WHERE value IS NOT NULL GROUP BY 1")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("value IS NOT NULL").withColumn("is_valid", F.col("value") >= 10)
    return pipeline.run_counters(e, ["event_type"])


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS events, max(value) AS largest FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    out = pipeline.tumbling(e, "ts", "6 hours", ["event_type"], {"events": F.count(F.lit(1)), "largest": F.max("value")})
    return out.select("start", "event_type", "events", "largest")


@query("""WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS o FROM events), n AS (SELECT *, sum(o) OVER (PARTITION BY event_type ORDER BY ts) AS s FROM g)
  SELECT event_type, min(ts) AS start, count(*) AS events FROM n GROUP BY event_type, s""")
def windows_by_gap(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return pipeline.session_windows(e, "ts", "20 minutes", ["event_type"]).select("event_type", "start", "events")


@query("""SELECT event_id, user_id, is_valid, service_day FROM (SELECT DISTINCT route || '-' || strftime(service_date, '%Y-%m-%d') AS event_id, route AS user_id, rides IS NOT NULL AND rides > 0 AS is_valid, service_date AS service_day FROM cta_ridership_sample)""")
def shared_transform(spark: SparkSession, folder: str) -> DataFrame:
    """The steps that streams and backfills share, on a table: identifier, validation flag, facts by day."""
    rows = table(spark, folder, "cta_ridership_sample").select("route", "service_date", "rides").distinct()
    facts = rows.select("service_date").distinct().withColumn("service_day", F.col("service_date"))
    out = pipeline.transform(rows, [Q.required("rides"), Q.positive("rides")], "route", "service_date", facts)
    return out.select(F.concat_ws("-", "route", F.date_format("service_date", "yyyy-MM-dd")).alias("event_id"), F.col("route").alias("user_id"), "is_valid", "service_day").distinct()


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS key, event_type AS kind, value FROM events""")
def outgoing_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as messages with key, JSON value and headers, read back from them."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    m = pipeline.messages(e, "user_id", ["event_type"])
    body = F.from_json("value", "event_id bigint, value double")
    return m.select(body.alias("b"), "key", F.col("headers")[0]["value"].cast("string").alias("kind")).select("b.event_id", "key", "kind", "b.value")


@query("""SELECT user_id, event_id, CAST(count(*) FILTER (event_type = 'click') OVER w AS INTEGER) AS clicks, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'open' END AS state FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def folded_states(spark: SparkSession, folder: str) -> DataFrame:
    """A state carried from event to event of each user, the batch form of a conversation."""

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        clicks = state.get("clicks", 0) + (row["event_type"] == "click")
        return {"clicks": clicks}, {"user_id": row["user_id"], "event_id": row["event_id"], "clicks": clicks, "state": "done" if row["event_type"] == "purchase" else "open"}

    e = table(spark, folder, "events").where("user_id IS NOT NULL").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("k"))
    e = e.withColumn("k", F.concat(F.date_format("k.ts", "yyyyMMddHHmmss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    return pipeline.ordered_fold(e, "user_id", "k", step, "user_id bigint, event_id bigint, clicks int, state string")


@query("""SELECT CAST(ts AS DATE) AS day, CAST(ts AS DATE) IN (SELECT service_date FROM cta_ridership_sample) AS found FROM events GROUP BY 1, 2""")
def remembered_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """Days looked up once; those without facts are remembered as well."""
    e = table(spark, folder, "events").select(F.col("ts").cast("date").alias("day"))
    facts = table(spark, folder, "cta_ridership_sample").select(F.col("service_date").alias("day"), "temperature_2m")
    early = pipeline.looked_up(e.where(F.dayofmonth("day") < 10), "day", facts)[1]
    return pipeline.looked_up(e, "day", facts, early)[1]


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS pieces FROM documents WHERE text IS NOT NULL")
def streamed_words(spark: SparkSession, folder: str) -> DataFrame:
    """A text as the pieces in which it would be sent."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "piece")).groupBy("doc_id").agg((F.max("at") + 1).alias("pieces"))


@query("SELECT o_orderpriority AS priority, isodow(o_orderdate) - 1 AS weekday, count(*) AS orders FROM orders GROUP BY 1, 2")
def priorities_in_order(spark: SparkSession, folder: str) -> DataFrame:
    out = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.weekday("o_orderdate").alias("weekday")).agg(F.count(F.lit(1)).alias("orders"))
    return in_given_order(out, "priority", ["5-LOW", "1-URGENT", "2-HIGH"])


@query(analytics.SQL["drift_report"], ("psi",))
def drift_file(spark: SparkSession, folder: str) -> DataFrame:
    """The drift report as a JSON file, read back."""
    path = scratch(spark, "drift")
    analytics.drift_report(spark, folder).write.mode("overwrite").json(path)
    return spark.read.schema("column string, psi double, status string, alert boolean").json(path)


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN lower(n_name) END AS text, CASE WHEN n_nationkey % 5 = 0 THEN 'ValueError: no answer' END AS error FROM nation")
def service_answers(spark: SparkSession, folder: str) -> DataFrame:
    """A service asked for every row; rows that it keeps failing carry its error."""

    def call(text: str) -> str:
        if int(text.rsplit("_", 1)[-1]) % 5 == 0:
            raise ValueError("no answer")
        return text.lower()

    n = table(spark, folder, "nation").select("n_name")
    return readers.answered(n, "n_name", call, tries=2, sleep=lambda _: None).select(F.col("n_name").alias("name"), "answer.text", "answer.error")


@query("SELECT '2024-01-31' AS day, 'rules.json' AS name, 2 AS sent")
def uploaded_files(spark: SparkSession, folder: str) -> DataFrame:
    """A file of the driver sent below a dated folder twice; the second one replaces the first."""
    import tempfile
    from pathlib import Path

    path = scratch(spark, "uploads")
    local = Path(tempfile.mkdtemp(prefix="millrace-send-")) / "rules.json"
    for n in (1, 2):
        local.write_text(json.dumps({"sent": n}))
        tables.upload(spark, [str(local)], path, "2024-01-31")
    found = readers.listing(spark, path, "*.json").select(F.regexp_extract("path", "/([0-9-]+)/[^/]+$", 1).alias("day"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return found.join(spark.read.schema("sent int").json(f"{path}/2024-01-31"))
