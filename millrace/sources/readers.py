"""Readers of files, catalog tables, nested payloads and paged services."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path without their contents: ``path, modificationTime, length``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "modificationTime", "length")


def csv(spark: SparkSession, path: str, schema: str | None = None, null: str = "", **options) -> DataFrame:
    """CSV with a header. State the schema: inferring one reads everything twice."""
    reader = spark.read.option("header", "true").option("nullValue", null).options(**options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def csv_coerced(spark: SparkSession, path: str, types: dict[str, str], **options) -> DataFrame:
    """CSV read as text and cast column by column; what cannot be cast becomes NULL instead of failing."""
    raw = spark.read.option("header", "true").options(**options).csv(path)
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns])


def first_available(spark: SparkSession, choices: Sequence[tuple[str, Callable[[str], DataFrame]]]) -> DataFrame:
    """The first of ``(path, reader)`` whose path exists."""
    for path, read in choices:
        if exists(spark, path):
            return read(path)
    raise FileNotFoundError(", ".join(p for p, _ in choices))


def first_working(choices: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first reader whose first row can be fetched, whatever the others fail with; the last error is raised."""
    for i, read in enumerate(choices):
        try:
            df = read()
            df.limit(1).collect()
            return df
        except Exception:  # noqa: BLE001
            if i == len(choices) - 1:
                raise
    raise ValueError("no reader")


def catalog(spark: SparkSession, name: str, columns: Sequence[str] = (), since: tuple[str, str] | None = None, isin: tuple[str, Sequence] | None = None) -> DataFrame:
    """A table of the catalog with projection, lower bound of a day and list of keys pushed to its scan."""
    df = spark.table(name)
    if since is not None:
        df = df.where(F.col(since[0]) >= F.lit(since[1]).cast(dict(df.dtypes)[since[0]]))
    if isin is not None:
        df = df.where(F.col(isin[0]).isin(list(isin[1])))
    return df.select(*columns) if columns else df


def remote_distinct(spark: SparkSession, path: str, column: str, kind: str = "string") -> DataFrame:
    """Distinct values of a column of a paged service: each page returns its own, which are then merged."""
    pages = spark.read.format("paged").option("path", path).option("schema", f"{column} {kind}").option("group", column).load()
    return pages.distinct()


def rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules kept as data: a JSON file with a list of objects, read on the driver."""
    return json.loads(spark.read.option("wholetext", "true").text(path).first()[0])


def checked_payload(df: DataFrame, error: str, reason: str) -> DataFrame:
    """The same rows; one that is an error answer of a service raises with its reason."""
    bad = F.when(F.coalesce(F.col(error), F.lit(False)), F.raise_error(F.concat(F.lit("service: "), F.col(reason))).cast("boolean"))
    return df.where(F.coalesce(bad, F.lit(True)))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (gzip too); blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines split into parsed rows and the text of broken lines."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value")
    good = parsed.where("r IS NOT NULL AND r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")
    return good, parsed.where("r IS NULL OR r._corrupt_record IS NOT NULL").select("value")


def partitioned_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON files (one document each, or JSON ``lines``) below ``key=value`` folders; a filter on the key reads those folders only."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def text_documents(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Whole text files below a path: ``path, text, sha256``. Bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha256"))


def changed_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path and hash are not in the manifest."""
    return found.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def parallel_arrays(df: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """A struct of equally long arrays (``hourly.time[i]``, ``hourly.rain[i]``) as one row per position."""
    rest = [c for c in df.columns if c != column]
    zipped = F.arrays_zip(*[F.col(f"{column}.{f}").alias(f) for f in fields])
    return df.select(*rest, F.posexplode(zipped).alias("position", "_x")).select(*rest, "position", *[F.col("_x").getField(f).alias(f) for f in fields])


def last_days(df: DataFrame, day: str, days: int, as_of: date | str) -> DataFrame:
    """Rows of the last ``days`` days up to a date; a plain filter, so it reaches the scan."""
    end = date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    start = end - timedelta(days=days - 1)
    return df.where((F.col(day) >= F.lit(start)) & (F.col(day) <= F.lit(end)))


def with_retry(call: Callable[[], list], tries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """Call, and call again after 1, 2, 4 ... seconds; the last error is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if i == tries - 1:
                raise
            sleep(base**i)
    return []


def answered(df: DataFrame, column: str, call: Callable[[str], str], name: str = "answer", tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Add what a service answers to each text: ``name`` as ``struct(text, error)``.

    Calls are repeated with growing pauses; one that keeps failing gives its error instead of ending the job.
    NULL texts are not asked. The call runs in Arrow batches on the executors.
    """

    @F.pandas_udf("struct<text: string, error: string>")
    def ask(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((None if t is None else with_retry(lambda t=t: call(t), tries, sleep=sleep), None))
            except Exception as e:  # noqa: BLE001
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return df.withColumn(name, ask(F.col(column)))


class LineService:
    """Stand-in for a paged service: a file of JSON lines that all tasks can open.

    One pass finds where the wanted rows begin; a page is then read by its places, without the rest of the file.
    """

    def __init__(self, path: str):
        self.path = path

    def places(self, where: Sequence[tuple], order: Sequence[str]) -> list[int]:
        """Byte positions of the rows that meet all conditions, in the order of the columns."""
        found, at = [], 0
        with open(self.path, "rb") as lines:
            for line in lines:
                if line.strip():
                    row = json.loads(line)
                    if all(row.get(c) is not None and TESTS[op](str(row[c]), v) for c, op, v in where):
                        found.append(([str(row.get(c)) for c in order], at))
                at += len(line)
        return [place for _, place in sorted(found)]

    def page(self, places: Sequence[int]) -> Iterator[dict]:
        with open(self.path, "rb") as lines:
            for place in places:
                lines.seek(place)
                yield json.loads(lines.readline())


TESTS = {"=": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b}


class _Page(InputPartition):
    def __init__(self, places: list[int]):
        self.places = places


class _PagedReader(DataSourceReader):
    """Pages of a service that takes WHERE, LIMIT and OFFSET; filters that it understands are pushed down.

    With the option ``group`` the service returns the distinct values of the columns of the schema only.
    """

    service = LineService

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options, self.where = schema, dict(options), []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            op = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThanOrEqual: "<=", In: "in"}.get(type(f))
            if op and len(f.attribute) == 1:
                self.where.append((f.attribute[0], op, [str(v) for v in f.value] if op == "in" else str(f.value)))
            else:
                yield f

    def partitions(self) -> list[_Page]:
        size = int(self.options.get("pagesize", 1000))
        found = with_retry(lambda: self.service(self.options["path"]).places(self.where, self.schema.names))
        return [_Page(found[o : o + size]) for o in range(0, max(len(found), 1), size)]

    def read(self, page: _Page) -> Iterator[tuple]:
        seen = set()
        for r in with_retry(lambda: list(self.service(self.options["path"]).page(page.places))):
            row = tuple(r.get(c) for c in self.schema.names)
            if "group" not in self.options or row not in seen:
                seen.add(row)
                yield row


class PagedSource(DataSource):
    """``spark.read.format("paged")``: one task per page of a paged service; register with ``register``.

    Options: ``path``, ``pagesize``, ``schema`` (DDL), ``group``. Subclasses of the reader replace ``service``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
