"""Problems 1 to 6 against brute force and at their edges."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest

from millrace.operators import orphans, packed, rolling, scan, sessions, shred, skew, spikes
from tests.conftest import rows

CTA = "route string, service_date date, day_type string, rides bigint, ingested_at timestamp_ntz, source string, value string"
START = date(2023, 1, 2)


def _cta(spark, data):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(r, d, t, v, at, "s", "clash") for r, d, t, v in data], CTA)


def _kind(d):
    return "A" if d.weekday() == 5 else "U" if d.weekday() == 6 else "W"


def _series(route, n=200, level=1000, seed=1):
    rng = random.Random(seed)
    share = {"W": 1.0, "A": 0.7, "U": 0.4}
    days = [START + timedelta(days=i) for i in range(n)]
    return [[route, d, _kind(d), round(level * share[_kind(d)] * rng.uniform(0.93, 1.07))] for d in days]


def _flagged(spark, data):
    found = spikes.flag_readings(_cta(spark, data), "route", "service_date", "rides", "day_type", "ingested_at")
    return {(r.source, (r.day - START).days): list(r.reasons) for r in found.collect() if r.reasons}


def test_spikes_found_by_kind(spark):
    data = _series("a")
    data[20][3] = 9999
    data[40][3] = -5
    data[60][3] = 40
    for i in range(90, 97):
        data[i][3] = 777
    got = _flagged(spark, data)
    assert set(got) == {("a", 20), ("a", 40), ("a", 60)} | {("a", i) for i in range(90, 97)}
    assert got[("a", 20)] == ["high"] and "impossible" in got[("a", 40)] and got[("a", 60)] == ["low"] and "frozen" in got[("a", 93)]


def test_lasting_change_of_level_is_no_spike(spark):
    data = _series("a")
    for r in data[100:]:
        r[3] = round(r[3] * 0.5)
    assert _flagged(spark, data) == {}


def test_own_busy_days_are_no_spikes_but_larger_ones_are(spark):
    data = _series("a", 300)
    rng = random.Random(3)
    for r in data:
        if rng.random() < 0.15:
            r[3] = round(r[3] * rng.uniform(1.4, 1.9))
    data[150][3] = data[150][3] * 9
    assert set(_flagged(spark, data)) == {("a", 150)}


def test_readings_edges(spark):
    data = _series("a", 60)
    data[10][3] = None
    data[11][2] = None
    data += [["a", None, "W", 5], [None, START, "W", 5], data[20], ["b", START, None, 7]]
    data[30][3] = -1
    assert set(_flagged(spark, data)) == {("a", 30)}
    assert _flagged(spark, []) == {}


def test_blocks_do_not_change_the_result(spark):
    data = _series("a", 400, seed=5)
    for i in (63, 64, 65, 127, 128):
        data[i][3] = 6000
    for i in range(190, 196):
        data[i][3] = 500
    df = _cta(spark, data)
    args = ("route", "service_date", "rides", "day_type", "ingested_at")
    whole = rows(spikes.flag_readings(df, *args), "day", "reasons")
    cut = rows(spikes.flag_readings(df, *args, settings=spikes.Fences(block=64)), "day", "reasons")
    assert whole == cut


def test_trailing_totals_brute_force(spark):
    rng = random.Random(2)
    data = [[r, START + timedelta(days=rng.randrange(120)), "W", rng.choice([None, 0, 3, -2, 8])] for r in "ab" for _ in range(50)]
    df = _cta(spark, data)
    got = rolling.trailing_totals(df, "route", "service_date", "rides")
    want = []
    for r in "ab":
        own = [(d, v or 0) for x, d, _, v in data if x == r]
        first, last = min(d for d, _ in own), max(d for d, _ in own)
        for i in range((last - first).days + 1):
            d = first + timedelta(days=i)
            t = [sum(v for e, v in own if 0 <= (d - e).days < n) for n in (7, 30)]
            want.append((r, d, t[0], t[1], t[0] / 7, t[1] / 30))
    assert rows(got) == sorted(want, key=repr)
    assert rolling.trailing_totals(df.limit(0), "route", "service_date", "rides").count() == 0


def test_versions_of_a_reading_count_once(spark):
    at = datetime(2024, 1, 1)
    data = [("a", START, "W", 5, at, "s", "x"), ("a", START, "W", 9, at + timedelta(days=1), "s", "x"), ("a", None, "W", 1, at, "s", "x")]
    got = rolling.trailing_totals(spark.createDataFrame(data, CTA), "route", "service_date", "rides", (7,), "ingested_at")
    assert rows(got, "total_7") == [(9,)]


EVENTS = "event_id string, user_id bigint, timestamp timestamp_ntz, received_at timestamp_ntz, session_id bigint, start string, day string"


def _events(spark, data):
    return spark.createDataFrame([(e, u, t, r, 1, "clash", "clash") for e, u, t, r in data], EVENTS)


def _brute_sessions(data, gap=30):
    first = {}
    for e, u, t, r in sorted((x for x in data if None not in x[:3]), key=lambda x: x[3]):
        first.setdefault(e, (u, t))
    out = []
    for u in {u for u, _ in first.values()}:
        own = sorted((t, e) for e, (v, t) in first.items() if v == u)
        held = [own[0]]
        for x in own[1:]:
            if x[0] - held[-1][0] > timedelta(minutes=gap):
                out.append((u, held[0][1], held[-1][1], len(held)))
                held = []
            held.append(x)
        out.append((u, held[0][1], held[-1][1], len(held)))
    return sorted(out, key=repr)


def _random_events(n, users, seed):
    rng = random.Random(seed)
    base = datetime(2024, 3, 1)
    out = []
    for i in range(n):
        t = base + timedelta(minutes=rng.choice([0, 15, 30, 31, 45, 1430, 1440]) + rng.randrange(0, 4000, 15))
        out.append((f"e{i}", rng.choice(users), t, t + timedelta(minutes=rng.choice([0, 1, 3000]))))
    out += [(e, u, t, r + timedelta(days=2)) for e, u, t, r in rng.sample(out, n // 10)]
    return out + [("n1", None, base, base), (None, 1, base, base), ("n2", 1, None, base)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_in_one_pass_and_in_batches(spark, seed):
    data = _random_events(300, [1, 1, 1, 2, 3], seed)
    df = _events(spark, data)
    want = _brute_sessions(data)
    cols = ("user_id", "first_event_id", "last_event_id", "events")
    assert rows(sessions.sessionize(df, "user_id", "event_id", "timestamp", "received_at"), *cols) == want
    got = sessions.incremental_sessions(df, "user_id", "event_id", "timestamp", "received_at", batches=3)
    assert rows(got, *cols) == want


def test_session_over_midnight_and_exact_gap(spark):
    t = datetime(2024, 3, 1, 23, 40)
    data = [(f"e{i}", 7, t + timedelta(minutes=30 * i), t) for i in range(4)] + [("z", 7, t + timedelta(minutes=120), t)]
    got = sessions.sessionize(_events(spark, data), "user_id", "event_id", "timestamp", "received_at")
    assert rows(got, "first_event_id", "last_event_id", "events") == [("e0", "z", 5)]
    data[-1] = ("z", 7, t + timedelta(minutes=120, seconds=1), t)
    got = sessions.sessionize(_events(spark, data), "user_id", "event_id", "timestamp", "received_at")
    assert rows(got, "first_event_id", "last_event_id", "events") == [("e0", "e3", 4), ("z", "z", 1)]


def test_late_event_bridges_stored_sessions_and_batches_repeat(spark):
    t = datetime(2024, 3, 1, 9)
    table = sessions.SessionTable(spark)
    first = _events(spark, [("a", 1, t, t), ("b", 1, t + timedelta(minutes=50), t), ("c", 2, t, t)])
    late = _events(spark, [("m", 1, t + timedelta(minutes=25), t)])
    make = lambda df: sessions.distinct_events(df, "user_id", "event_id", "timestamp", "received_at")
    table.apply(make(first))
    assert rows(table.read(), "first_event_id", "last_event_id") == [("a", "a"), ("b", "b"), ("c", "c")]
    table.apply(make(late))
    table.apply(make(late))
    table.vacuum()
    assert rows(table.read(), "user_id", "first_event_id", "last_event_id", "events") == [(1, "a", "b", 3), (2, "c", "c", 1)]


def test_sessions_of_nothing(spark):
    df = _events(spark, [])
    assert sessions.sessionize(df, "user_id", "event_id", "timestamp").count() == 0
    assert sessions.incremental_sessions(df, "user_id", "event_id", "timestamp", "received_at").count() == 0


def _split(spark, texts):
    df = spark.createDataFrame([(i, t, "v", 1.0) for i, t in enumerate(texts)], "id int, investors string, value string, weight double")
    out = {}
    for r in packed.split_packed(df, "id", "investors").orderBy("id", "position_no").collect():
        out.setdefault(r.id, []).append(r.value)
    return out


def test_packed_forms(spark):
    texts = [
        "Alpha Fund; Beta Labs ;; Gamma VC", ' "Delta Holdings, Ltd." , Alpha Fund', '["Alpha Fund", "Eps \\"X\\" Fund"]', "'Beta Labs', 'Gamma VC'",
        "Alpha Fund\r\n\r\nBeta Labs\n", "n/a", "", None, "Alpha Fund, Beta Labs, and Gamma VC", 'Zed "Q" Fund | "Zed ""Q"" Fund"', "Alpha Fund / Beta Labs", " \xa0Alpha Fund,\xa0Alpha Fund ",
    ]
    got = _split(spark, texts)
    assert got == {
        0: ["Alpha Fund", "Beta Labs", "Gamma VC"], 1: ["Delta Holdings, Ltd.", "Alpha Fund"], 2: ["Alpha Fund", 'Eps "X" Fund'], 3: ["Beta Labs", "Gamma VC"],
        4: ["Alpha Fund", "Beta Labs"], 8: ["Alpha Fund", "Beta Labs", "Gamma VC"], 9: ['Zed "Q" Fund', 'Zed "Q" Fund'], 10: ["Alpha Fund", "Beta Labs"], 11: ["Alpha Fund", "Alpha Fund"],
    }


def test_packed_names_with_delimiters_are_learned(spark):
    rng = random.Random(4)
    names = [f"{a} {b}" for a in ("Ara", "Bor", "Cal", "Dun", "Eri") for b in ("Fund", "Labs", "Seed")]
    hard = ["Ara Holdings, Inc.", "Bor and Cal Partners", "Dun & Eri", "Cal/Dun Ventures", "Vim, Ola & Tes"]
    truth = [[rng.choice(names + hard) for _ in range(rng.randint(1, 5))] for _ in range(400)]
    texts = []
    for x in truth:
        d = rng.choice([", ", "; ", " | ", " / "])
        quote = lambda n, d=d: f'"{n}"' if d == ", " and "," in n and rng.random() < 0.7 else n
        texts.append(d.join(quote(n) for n in x))
    got = _split(spark, texts)
    right = sum(got.get(i) == x for i, x in enumerate(truth))
    assert right >= 0.98 * len(truth)


def test_packed_round_trip_of_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "A Fund; B Fund"), (1, "A Fund; B Fund"), (2, None)], "id int, investors string")
    assert rows(packed.split_packed(df, "id", "investors")) == [(1, 1, "A Fund"), (1, 2, "B Fund")]
    assert packed.split_packed(df.limit(0), "id", "investors").count() == 0
    long = ", ".join(f"N{i} Fund" for i in range(500))
    got = _split(spark, [long])
    assert len(got[0]) == 500


def _refs(spark, children, parents):
    c = spark.createDataFrame(children, "k string, ref bigint, at timestamp_ntz, key string, life int")
    p = spark.createDataFrame(parents, "id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz, at int")
    return [orphans.Reference("c", c, "k", "ref", "at", "p", p, "id", "loaded_at", "deleted_at")]


def test_orphans_brute_force(spark):
    rng = random.Random(6)
    t0 = datetime(2024, 1, 1)
    t = lambda: t0 + timedelta(days=rng.randrange(100))
    parents = [(rng.randrange(20), t(), rng.choice([None, t()]), 0) for _ in range(25)] + [(3, t0, None, 0)] * 3 + [(None, t0, None, 0)]
    children = [(f"k{i}", rng.choice([3, 3, None, *range(25)]), rng.choice([t(), t(), None]) if i % 9 == 0 else t(), "x", 1) for i in range(200)]
    children += children[:20]
    want = set()
    for k, ref, at, *_ in children:
        alive = any(p == ref and at and l <= at and (d is None or d > at) for p, l, d, _ in parents)
        if ref is not None and not alive:
            want.add(("c", k, at and at.strftime("%Y-%m")))
    refs = _refs(spark, children, parents)
    assert rows(orphans.orphans(refs), "table_name", "row_key", "period") == sorted(want, key=repr)
    total = sum(r.orphan_rows for r in orphans.orphan_report(refs).collect())
    assert total == len(want)


def test_orphans_of_empty_tables(spark):
    assert orphans.orphans(_refs(spark, [], [])).count() == 0
    at = datetime(2024, 1, 1)
    assert rows(orphans.orphans(_refs(spark, [("k", 1, at, "x", 1)], [])), "row_key") == [("k",)]


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(i, i) for i in range(2, 40)] + [(None, 0)], "k int, x int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 30)] + [(1, "again"), (None, "n")], "k int, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew.salted_join(left, right, ["k"], how)) == rows(left.join(right, "k", how)), how


def test_positions_and_running_totals(spark):
    rng = random.Random(8)
    data = [("a", rng.randrange(5), i, rng.randrange(9)) for i in range(60)]
    df = spark.createDataFrame(data, "k string, b int, o int, v int")
    order = sorted(data, key=lambda x: (x[1], x[2]))
    got = {r.o: (r.n, r.s) for r in scan.running_total(scan.with_position(df, ["k"], "b", ["o"], "n"), ["k"], "b", ["o"], "v", "s").collect()}
    assert got == {x[2]: (i, sum(y[3] for y in order[:i])) for i, x in enumerate(order)}


LINE = {"productId": 1, "options": [{"name": "size", "value": "M"}, None, {}], "parts": {"productId": 2, "discounts": [{"code": "X", "tiers": [{"min": 1}]}]}, "gift": {"wrap": True}}


@pytest.mark.parametrize(
    "text",
    [json.dumps([LINE]), json.dumps(LINE), json.dumps(json.dumps([LINE])), "﻿  " + json.dumps({"products": [LINE], "v": 0}) + "\n", repr([LINE])],
)
def test_shred_dialects(spark, text):
    got = sorted(n[0] for n in shred.shred(shred.parse(text), ["options", "discounts", "tiers", "parts"], "lines", "products") if n[6] == "object" and n[2])
    assert got == ["0", "0/options/0", "0/parts/0", "0/parts/0/discounts/0", "0/parts/0/discounts/0/tiers/0"]


@pytest.mark.parametrize("text", [None, "", "  ", "null", "[", json.dumps([LINE])[:-3], "\"[\"", "7", "[]", "[null]"])
def test_shred_of_nothing(text):
    assert [n for n in shred.shred(shred.parse(text), ["options"], "lines", "products") if n[6] == "object"] == []


def test_shred_deep_and_entities(spark):
    deep = {"productId": 0}
    for i in range(300):
        deep = {"productId": i, "parts": [deep]}
    data = [(1, json.dumps([LINE]), 1, "t"), (1, json.dumps([LINE, {"quantity": "3"}]), 2, "t"), (2, json.dumps([deep]), 1, "t"), (3, "[{", 2, "t"), (3, "[{}]", 1, "t"), (None, "[]", 1, "t")]
    df = spark.createDataFrame(data, "id bigint, body string, at int, node string")
    last = shred.latest(df, "id", "at", ["body"])
    nodes = shred.adjacency(last, "id", "body", ["options", "parts", "discounts", "tiers"])
    lines = shred.entity_table(nodes, "id", "lines", {"product_id": ("productId",), "quantity": ("quantity",)})
    assert rows(lines, "id", "node", "product_id", "quantity") == [(1, "0", "1", None), (1, "1", None, "3"), (2, "0", "299", None)]
    parts = shred.entity_table(nodes, "id", "parts", {"product_id": ("productId",)})
    assert parts.where("id = 2").count() == 300 and rows(parts.where("id = 1"), "parent", "parent_entity") == [("0", "lines")]
    assert shred.adjacency(last.limit(0), "id", "body", ["parts"]).count() == 0


def test_shred_text_packed_many_times_and_any_depth():
    text = [LINE]
    for _ in range(6):
        text = json.dumps(text)
    assert shred.parse(text) == [LINE]
    deep = "[" * 20_000 + "{'parts': [{}]}" + "]" * 20_000
    assert shred.parse(deep) is not None
    nested = '{"productId": 1, "parts": [' * 12_000 + '{"productId": 2}' + "]}" * 12_000
    found = sum(1 for n in shred.shred(shred.parse(nested), ["parts"], "lines", "products") if n[6] == "object")
    assert found == 12_001


@pytest.mark.parametrize("text", ["[1, 2", "[1 2]", "{'a' 1}", '{"a": }', "[1] x", "", "[nope]", "{[1]: 2}", '["x]'])
def test_deep_reader_refuses_what_is_no_value(text):
    with pytest.raises((ValueError, SyntaxError, KeyError, TypeError)):
        shred.read_deep(text)


def test_deep_reader_reads_both_dialects():
    value = {"a": [1, 2.5, -3e4, "x\"y", None, True, {}, []], "b": {"c": "it's"}}
    assert shred.read_deep(json.dumps(value)) == value
    assert shred.read_deep(repr(value)) == value
    assert shred.read_deep("{'a': (1, 2,), 'b': {'c': None,}}") == {"a": [1, 2], "b": {"c": None}}


def test_scalars_of_nested_plain_objects_reach_their_record(spark):
    body = json.dumps([{"productId": 1, "gift": {"wrap": True, "card": {"text": "hi"}}, "options": [{"name": "size", "meta": {"flags": [1, None], "by": "web"}}]}])
    nodes = shred.adjacency(spark.createDataFrame([(1, body)], "id bigint, body string"), "id", "body", ["options"])
    lines = shred.entity_table(nodes, "id", "lines", {"wrap": ("gift_wrap",), "card": ("gift_card_text",), "name": ("name",)})
    assert rows(lines, "node", "wrap", "card", "name") == [("0", "true", "hi", None)]
    options = shred.entity_table(nodes, "id", "options", {"flags": ("meta_flags",), "by": ("meta_by",)})
    assert rows(options, "node", "flags", "by") == [("0/options/0", "[1, null]", "web")]


def test_packed_quotes_after_long_gaps_and_names_of_many_pieces(spark):
    many = "Ash, Bay, Cob, Dew, Elm, Fir & Gum"
    texts = [f'Alpha Fund,{" " * 40}"Beta, Gamma LLC"', f'"{many}"; Alpha Fund', f'"{many}" | Beta Labs', f'"{many}"', many, f"Alpha Fund; {many}", '"A, B" "C, D"']
    got = _split(spark, texts)
    assert got[0] == ["Alpha Fund", "Beta, Gamma LLC"]
    assert got[1] == [many, "Alpha Fund"]
    assert got[4] == [many] and got[5] == ["Alpha Fund", many]


def test_packed_hot_field_and_hot_name(spark):
    texts = ["Alpha Fund, Beta Labs"] * 300 + [f"N{i} Fund / Beta Labs" for i in range(60)]
    got = _split(spark, texts)
    assert all(got[i] == ["Alpha Fund", "Beta Labs"] for i in range(300))
    assert all(got[300 + i] == [f"N{i} Fund", "Beta Labs"] for i in range(60))
