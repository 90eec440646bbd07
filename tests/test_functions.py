from __future__ import annotations

import math
import uuid
from datetime import date

from pyspark.sql import functions as F

from millrace.functions import dates, ids, numbers, text, vectors


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def L(x):
    return F.lit(x)


def test_numbers(spark):
    null = F.lit(None).cast("double")
    got = one(
        spark,
        a=numbers.ratio(L(1), L(0)), b=numbers.percent_change(L(3.0), L(2.0)), c=numbers.buckets(L(5), (5, 10), "xyz"), d=numbers.buckets(L(5), (5, 10), "xyz", right=True),
        e=numbers.buckets(null, (5,), "xy", missing="none"), f=numbers.clip(L(-3), 0, 9), g=numbers.number(L("x")), h=numbers.number(L("1.5")),
        i=numbers.lookup(L("q"), {"a": 1}, 0), j=numbers.weather_score(L(-11.0), L(55.0), L(6.0)), k=numbers.weather_score(null, null, null), m=numbers.weather_score(L(-1.0), L(31.0), L(0.2)),
    )
    assert got == {"a": None, "b": 50.0, "c": "y", "d": "x", "e": "none", "f": 0, "g": None, "h": 1.5, "i": 0, "j": 80, "k": 0, "m": 28}


def test_columns_that_differ_count_nulls(spark):
    df = spark.createDataFrame([("No", None, "Up")], "a string, b string, c string")
    assert df.select(numbers.count_differing(["a", "b", "c"], "No").alias("n")).first().n == 2


def test_icd9_groups(spark):
    codes = {"250.01": "Diabetes", "E812": "Other", "V57": "Other", "428": "Circulatory", "785": "Circulatory", "459.5": "Other", "486": "Respiratory", "540": "Digestive", "820": "Injury", "715": "Musculoskeletal", "599": "Genitourinary", "174": "Neoplasms", "?": "Other", None: "Other"}
    df = spark.createDataFrame([(k, v) for k, v in codes.items()], "code string, want string")
    assert df.where(numbers.icd9_group(F.col("code")) != F.col("want")).count() == 0


def test_dates(spark):
    d = lambda x: F.lit(date.fromisoformat(x))
    got = one(
        spark,
        a=dates.months_between_starts(d("2024-02-29"), d("2024-01-31")), b=dates.week_ending_sunday(d("2024-03-10")), c=dates.week_ending_sunday(d("2024-03-11")),
        e=dates.relative_week(d("2024-02-29"), "2024-03-01"), f=dates.month(d("2024-02-29")), **{n: c for n, c in dates.calendar(d("2024-02-29")).items() if n in ("day_of_week", "is_month_end", "quarter")},
    )
    assert got == {"a": 1, "b": date(2024, 3, 10), "c": date(2024, 3, 17), "e": -1, "f": date(2024, 2, 1), "day_of_week": 3, "is_month_end": True, "quarter": 1}
    holidays = ["2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25"]
    year = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-12-31')) AS d")
    assert [str(r.d) for r in year.where(dates.us_federal_holiday(F.col("d"))).orderBy("d").collect()] == holidays


def test_text(spark):
    got = one(
        spark,
        clean=text.clean(L("  Hëllo,  WORLD!\n42. ")), none=text.clean(F.lit(None).cast("string")), n=text.word_count(L(" a  b\tc ")), z=text.word_count(L("  ")),
        mails=text.emails(L("A@b.example, a@b.example; c.d@e-f.example.")), tel=text.phones(L("call (312) 555-1234 or 312.555.9999")), links=text.urls(L("see https://a.example/x. and (http://b.example)")),
        obj=text.json_object(L('```json\n{"a": {"b": 1}}\n``` ok')), no=text.json_object(L("nothing")), s=text.sentences(L("One. Two!\nThree")), yes=text.truth(L("Yes, please")), both=text.truth(L("yes and no")),
        i=text.first_int(L("about 12 of 30")), meta=text.metadata_line(L("# T\nSource: here\n"), "Source"), host=text.link_host(L("https://www.A.example:80/x")), cut=text.snippet(L("abcdef"), 3),
        words=text.without_stopwords(L("The quick fox of an era"), ["the", "of"]), relaxed=text.relaxed_json(L("{'rate': 3.9}"), "rate double"),
    )
    assert got["clean"] == "h llo, world 42." and got["none"] == "" and (got["n"], got["z"]) == (3, 0)
    assert got["mails"] == ["a@b.example", "c.d@e-f.example"] and got["tel"] == ["(312) 555-1234", "312.555.9999"]
    assert got["links"] == ["https://a.example/x", "http://b.example"] and got["obj"] == '{"a": {"b": 1}}' and got["no"] is None
    assert got["s"] == ["One.", "Two!", "Three"] and got["yes"] is True and got["both"] is None and got["i"] == 12
    assert got["meta"] == "here" and got["host"] == "a.example" and got["cut"] == "abc..." and got["words"] == "quick fox era" and got["relaxed"].rate == 3.9


def test_uuid5_and_content_id(spark):
    names = ["22-2024-01-01", "", "ü", "x" * 500]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.u for r in df.select("n", ids.uuid5(F.col("n")).alias("u")).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    assert one(spark, u=ids.uuid5(F.lit(None).cast("string")))["u"] is None
    assert len(one(spark, c=ids.content_id(L("a"), L(None)))["c"]) == 32


def test_vectors(spark):
    a, b, z = F.array(L(3.0), L(4.0)), F.array(L(4.0), L(3.0)), F.array(L(0.0), L(0.0))
    got = one(spark, d=vectors.dot(a, b), n=vectors.norm(a), c=vectors.cosine(a, b), z=vectors.cosine(a, z), top=vectors.top_classes(F.array(L(0.2), L(0.5), L(0.3)), ["x", "y", "z"], 2))
    assert got["d"] == 24 and got["n"] == 5 and math.isclose(got["c"], 0.96) and got["z"] is None
    assert [t.label for t in got["top"]] == ["y", "z"]
