from __future__ import annotations

import gzip
import json
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.quality import positive, required
from millrace.sources import readers, tables
from millrace.streaming import pipeline
from tests.conftest import rows


# readers
def test_csv_forms(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,n,d\n1,5,2024-01-01\n2,?,x\n3,bad,2024-02-30\n")
    assert rows(readers.csv(spark, str(p), "id int, n string, d string", null="?"), "n") == [("5",), ("bad",), (None,)]
    assert rows(readers.csv_coerced(spark, str(p), {"n": "int", "d": "date"}), "id", "n", "d") == [("1", 5, date(2024, 1, 1)), ("2", None, None), ("3", None, None)]
    got = readers.first_available(spark, [(str(tmp_path / "none"), spark.read.parquet), (str(p), lambda x: readers.csv(spark, x))])
    assert got.count() == 3
    with pytest.raises(FileNotFoundError):
        readers.first_available(spark, [(str(tmp_path / "none"), spark.read.parquet)])


def test_jsonl_and_documents(spark, tmp_path):
    p = tmp_path / "x.jsonl.gz"
    with gzip.open(p, "wt") as f:
        f.write('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert rows(readers.jsonl(spark, str(p), "a int").where("a IS NOT NULL")) == [(1,), (2,)]
    good, bad = readers.jsonl_with_rejects(spark, str(p), "a int")
    assert rows(good) == [(1,), (2,)] and rows(bad) == [('{"a": ',)]
    docs = tmp_path / "docs" / "sub"
    docs.mkdir(parents=True)
    (docs / "a.md").write_bytes(b"# T\xff\n")
    (docs / "b.md").write_text("two")
    (docs / "c.txt").write_text("no")
    found = readers.text_documents(spark, str(tmp_path / "docs"))
    assert found.count() == 2 and readers.listing(spark, str(tmp_path / "docs"), "*.md").count() == 2
    assert readers.changed_files(found, found.limit(1)).count() == 1
    day = tmp_path / "raw" / "dt=2024-01-01"
    day.mkdir(parents=True)
    (day / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert rows(readers.partitioned_json(spark, str(tmp_path / "raw"), "a int"), "a", "dt") == [(1, date(2024, 1, 1)), (2, date(2024, 1, 1))]


def test_parallel_arrays_and_retry(spark):
    df = spark.createDataFrame([("s", {"time": ["a", "b"], "t": [1.0, None]})], "station string, hourly struct<time: array<string>, t: array<double>>")
    assert rows(readers.parallel_arrays(df, "hourly", ["time", "t"])) == [("s", 0, "a", 1.0), ("s", 1, "b", None)]
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [1]

    assert readers.with_retry(flaky, sleep=waits.append) == [1] and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        readers.with_retry(lambda: 1 / 0, sleep=waits.append)


def test_paged_source(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text("\n".join(json.dumps({"route": str(i % 3), "n": i}) for i in range(25)))
    readers.register(spark)
    df = spark.read.format("paged").option("path", str(p)).option("pagesize", "4").option("schema", "route string, n int").load()
    assert df.count() == 25
    assert sorted(r.n for r in df.where("route = '1'").collect()) == list(range(1, 25, 3))


def test_last_days(spark):
    df = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-31')) AS d")
    assert readers.last_days(df, "d", 7, "2024-01-20").count() == 7


# tables
def test_versioned_table(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists() and t.version == 0
    with pytest.raises(ValueError):
        t.read()
    t.append(spark.createDataFrame([(1, "a")], "k int, s string"))
    between = time.time()
    time.sleep(0.01)
    t.append(spark.createDataFrame([(2, "b", 5)], "k int, s string, extra int"))
    assert rows(t.read()) == [(1, "a", None), (2, "b", 5)] and rows(t.read(1)) == [(1, "a")] and rows(t.read(as_of=between)) == [(1, "a")]
    t.upsert(spark.createDataFrame([(2, "B", 6), (3, "c", 7)], "k int, s string, extra int"), ["k"])
    assert rows(t.read(), "k", "s") == [(1, "a"), (2, "B"), (3, "c")]
    t.overwrite(spark.createDataFrame([(9,)], "z int"))
    assert t.read().columns == ["z"]
    t.restore(3)
    assert t.read().count() == 3 and [x["operation"] for x in t.history()] == ["append", "append", "upsert", "overwrite", "restore"]
    t.vacuum(1)
    assert t.read().count() == 3 and len(t.history()) == 1


def test_upsert_by_version_ignores_older_and_repeats(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "t"))
    make = lambda *x: spark.createDataFrame(list(x), "k int, v int, s string")
    t.upsert(make((1, 2, "two"), (1, 1, "one")), ["k"], ["v"])
    t.upsert(make((1, 1, "late"), (2, 1, "x")), ["k"], ["v"])
    t.upsert(make((1, 1, "late"), (2, 1, "x")), ["k"], ["v"])
    assert rows(t.read()) == [(1, 2, "two"), (2, 1, "x")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-02", 2)], "route string, day string, n int")
    path = str(tmp_path / "j")
    tables.write_json_by_key(df, path, ["day"])
    tables.write_json_by_key(df.where("day = '2024-01-02'").withColumn("n", F.lit(7)), path, ["day"])
    assert rows(spark.read.json(path), "n") == [(1,), (7,)]
    tables.append_log(df, str(tmp_path / "log"), "day")
    tables.append_log(df, str(tmp_path / "log"), "day")
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    tables.write_split(df, df.limit(0), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    assert rows(tables.export({"one": df, "two": df.limit(1)}, str(tmp_path / "out"))) == [("one", 2), ("two", 1)]
    assert tables.create_view(df, "millrace_v", tables.VersionedTable(spark, str(tmp_path / "m"))).count() == 2 and spark.table("millrace_v").count() == 2
    assert tables.stamped(df, source="x").first().source == "x"


# streams
SCHEMA = "route string, service_date string, rides int, ingested_at timestamp"


def _write(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages) + "\n")


def test_stream_to_table_with_rejects_and_late_corrections(spark, tmp_path):
    m = lambda r, d, n, at: {"route": r, "service_date": d, "rides": n, "ingested_at": at}
    src = tmp_path / "in"
    facts = spark.createDataFrame([("2024-01-01", 5.0)], "service_date string, temperature double")
    rules = [required("route"), positive("rides")]
    t = tables.VersionedTable(spark, str(tmp_path / "t"))

    def run():
        good, broken = pipeline.decode(pipeline.json_stream(spark, str(src)), SCHEMA)
        events = pipeline.transform(good, rules, "route", "service_date", facts)
        pipeline.upsert_sink(events, t, ["event_id"], ["ingested_at"], str(tmp_path / "cp"), str(tmp_path / "dead")).awaitTermination()

    _write(src, "1.json", [m("22", "2024-01-01", 100, "2024-01-02T00:00:00"), m("22", "2024-01-02", -1, "2024-01-02T00:00:00"), "{broken"])
    run()
    _write(src, "2.json", [m("22", "2024-01-01", 120, "2024-01-03T00:00:00"), m("36", "2024-01-01", 50, "2024-01-03T00:00:00")])
    run()
    _write(src, "3.json", [m("22", "2024-01-01", 90, "2024-01-01T12:00:00")])
    run()
    assert rows(t.read(), "route", "rides", "temperature") == [("22", 120, 5.0), ("36", 50, 5.0)]
    assert spark.read.json(str(tmp_path / "dead")).where("validation_errors LIKE '%not positive%'").count() == 1
    batch = pipeline.transform(pipeline.decode(spark.read.text(str(src)), SCHEMA)[0], rules, "route", "service_date", facts)
    assert rows(pipeline.run_counters(batch)) == [(5, 4, 1)]
    msg = pipeline.messages(batch, "event_id", ["route"]).first()
    assert json.loads(msg.value)["event_id"] == msg.key and msg.headers[0].key == "route"


def _stream(spark, tmp_path, data):
    df = spark.createDataFrame(data, "k string, at timestamp, id string")
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


T0 = datetime(2024, 1, 1, 10)


def test_windows_and_dedup(spark, tmp_path):
    data = [("a", T0 + timedelta(minutes=i), f"e{i % 5}") for i in range(8)] + [("a", T0 + timedelta(days=2), "last")]
    events = _stream(spark, tmp_path, data)
    got = _run(pipeline.tumbling(events, "at", "5 minutes", ["k"], {"n": F.count(F.lit(1))}), "tumbling", "complete")
    assert sorted(r.n for r in got.collect()) == [1, 3, 5]
    got = _run(pipeline.deduplicated(events, "at", ["id"]), "deduplicated")
    assert got.count() == 6
    got = _run(pipeline.session_windows(events, "at", "30 minutes", ["k"]), "session_windows", "complete")
    assert rows(got, "events") == [(1,), (8,)]


def test_rate_limit_state(spark, tmp_path):
    data = [("a", T0 + timedelta(minutes=m), str(m)) for m in (0, 10, 20, 59, 61, 70)] + [("b", T0, "x")]
    got = _run(pipeline.rate_limited(_stream(spark, tmp_path, data), "k", "at", 2), "limited", "append")
    assert [r.allowed for r in got.where("key = 'a'").orderBy("at").collect()] == [True, True, False, False, True, True]


def test_ordered_fold(spark):
    turns = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), ("d", 1, "z")], "conv string, turn int, text string")

    def step(state, row):
        state = {"seen": state.get("seen", "") + row["text"]}
        return state, {"conv": row["conv"], "turn": row["turn"], "so_far": state["seen"]}

    got = pipeline.ordered_fold(turns, "conv", "turn", step, "conv string, turn int, so_far string")
    assert rows(got) == [("c", 1, "a"), ("c", 2, "ab"), ("d", 1, "z")]


def test_stream_into_session_table(spark, tmp_path):
    from millrace.operators.sessions import SessionTable

    schema = "event_id string, user_id bigint, at timestamp_ntz, got timestamp_ntz"
    t = datetime(2024, 1, 1, 23, 50)
    parts = [[("a", 1, 0), ("b", 1, 50)], [("m", 1, 25), ("c", 2, 0)], [("m", 1, 25), ("z", 1, 300)]]
    table = SessionTable(spark, str(tmp_path / "sessions"))
    for part in parts:
        rows_ = [(e, u, t + timedelta(minutes=m), t) for e, u, m in part]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
        pipeline.session_sink(stream, table, "user_id", "event_id", "at", "got", str(tmp_path / "cp")).awaitTermination()
    assert rows(table.read(), "user_id", "first_event_id", "last_event_id", "events") == [(1, "a", "b", 3), (1, "z", "z", 1), (2, "c", "c", 1)]


def test_a_version_is_written_once(spark, tmp_path):
    from millrace.sources.log import CommitLog, Conflict

    a, b = CommitLog(spark, str(tmp_path / "t")), CommitLog(spark, str(tmp_path / "t"))
    assert a.last() is None
    a.commit(1, {"x": 1})
    with pytest.raises(Conflict):
        b.commit(1, {"x": 2})
    b.commit(2, {"x": 3})
    assert a.last() == {"x": 3}
    a.forget()
    assert a.last() == {"x": 3}


def test_upsert_by_buckets_equals_upsert_of_the_whole(spark, tmp_path):
    make = lambda data: spark.createDataFrame(data, "k string, v int, at int")
    batches = [
        make([(f"k{i}", i, 1) for i in range(40)]),
        make([("k1", 100, 2), ("k50", 5, 2), ("k2", 7, 0)]).withColumn("more", F.lit("m")),
        make([("k1", 100, 2), (None, 3, 1)]),
    ]
    whole, parted = tables.VersionedTable(spark, str(tmp_path / "a")), tables.VersionedTable(spark, str(tmp_path / "b"), buckets=8)
    for b in batches:
        whole.upsert(b, ["k"], ["at"])
        parted.upsert(b, ["k"], ["at"])
    assert rows(parted.read(), "k", "v", "at", "more") == rows(whole.read(), "k", "v", "at", "more")
    log = parted.history()
    assert len(set(log[0]["parts"]) & set(log[1]["parts"])) >= 5
    parted.vacuum()
    assert rows(parted.read(), "k", "v") == rows(whole.read(), "k", "v")
