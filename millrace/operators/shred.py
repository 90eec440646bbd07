"""Shredding nested JSON into an adjacency table and flat entity tables (problem 6)."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

NODES = "node string, parent string, entity string, parent_entity string, label string, ordinal int, kind string, scalar string, record string, field string"
"""One row per JSON value. ``node`` is its path; ``entity`` is set on objects that stand for a record.

``record`` is the path of the record that a value belongs to, ``field`` its place below it, labels joined by "_":
a scalar ``wrap`` of an object ``gift`` is the field ``gift_wrap``. An array of scalars also carries its JSON
text as ``scalar``, under its own field.
"""

_SPACE = re.compile(r"[ \t\r\n\f\v]*")
_WORD = re.compile(r"-?[A-Za-z0-9_.+-]+")
_TEXT = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", re.S)
_WORDS = {"null": None, "None": None, "true": True, "True": True, "false": False, "False": False}


def read_deep(text: str):
    """One JSON value or Python literal of any depth, read with a list in place of recursion; ValueError if it is none."""

    def scalar(at: int):
        m = _TEXT.match(text, at)
        if m:
            return (json.loads(m[0], strict=False) if m[0][0] == '"' else ast.literal_eval(m[0])), m.end()
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"no value at {at}")
        return (_WORDS[m[0]] if m[0] in _WORDS else json.loads(m[0])), m.end()

    skip = lambda i: _SPACE.match(text, i).end()
    open_: list[tuple] = []  # containers that are not closed yet, with the key to fill
    at, value, filled = skip(0), None, False
    while True:
        if not filled:
            c = text[at : at + 1]
            if c and c in "[{(":
                open_.append([{} if c == "{" else [], "}" if c == "{" else "]" if c == "[" else ")", None])
                at = skip(at + 1)
                if text[at : at + 1] == open_[-1][1]:
                    value, filled, at = open_.pop()[0], True, skip(at + 1)
                    continue
            else:
                value, at = scalar(at)
                filled, at = True, skip(at)
                continue
        else:
            if not open_:
                if at != len(text):
                    raise ValueError(f"text after the value at {at}")
                return value
            held, end, key = open_[-1]
            held.__setitem__(key, value) if end == "}" else held.append(value)
            filled = False
            mark = text[at : at + 1]
            at = skip(at + 1)
            if mark == "," and end != "]" and text[at : at + 1] == end:
                mark, at = end, skip(at + 1)
            if mark == end:
                open_.pop()
                value, filled = held, True
                continue
            if mark != ",":
                raise ValueError(f"neither comma nor end at {at}")
        if open_[-1][1] == "}":
            open_[-1][2], at = scalar(at)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = skip(at + 1)


def parse(text: str | None):
    """The value written in ``text`` by any of the clients, or None.

    Byte order marks and white space around the value, text packed any number of times as a JSON string, any depth, and
    Python literals (single quotes, None, True) are understood. Text that is cut off, empty or
    otherwise no value gives None; nothing is guessed.
    """
    value = text
    while isinstance(value, str):
        bare = value.strip("\ufeff\u200b\u00a0 \t\r\n\f\v")
        if not bare:
            return None
        try:
            value = json.loads(bare)
        except RecursionError:
            try:
                value = read_deep(bare)
            except (ValueError, SyntaxError, KeyError, TypeError):
                return None
        except ValueError:
            try:
                value = ast.literal_eval(bare)
            except (MemoryError, RecursionError):
                try:
                    value = read_deep(bare)
                except (ValueError, SyntaxError, KeyError, TypeError):
                    return None
            except (ValueError, SyntaxError, TypeError):
                return None
        if value == bare:
            return None
    return value


def _scalar(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def shred(value, entities: Sequence[str], root: str, wrapper: str) -> Iterator[tuple]:
    """The rows of ``NODES`` for one parsed value, parents before children.

    ``root`` names the entity of the top list, ``entities`` the fields that hold records. A lone
    object in place of a list stands at 0. An outer object with a list ``wrapper`` only wraps it.
    Empty elements keep their place and give no row. Work is kept on a list, so depth is no limit.
    """
    if isinstance(value, dict) and isinstance(value.get(wrapper), (list, dict)):
        value = value[wrapper]
    if isinstance(value, dict):
        value = [value]
    if not isinstance(value, (list, tuple)):
        return
    todo = [(str(i), None, root, None, root, i, x, None, "") for i, x in reversed(list(enumerate(value)))]
    while todo:
        path, parent, entity, above, label, ordinal, x, record, field = todo.pop()
        if isinstance(x, dict):
            if not x:
                continue
            yield path, parent, entity, above, label, ordinal, "object", None, record, field
            if entity is not None:
                record, field = path, ""
            here = entity if entity is not None else above
            under = f"{field}_" if field else ""
            for key, child in reversed(x.items()):
                key = str(key)
                if key in entities and isinstance(child, (dict, list, tuple)):
                    items = [child] if isinstance(child, dict) else child
                    for i in range(len(items) - 1, -1, -1):
                        todo.append((f"{path}/{key}/{i}", path, key, here, key, i, items[i], record, ""))
                else:
                    todo.append((f"{path}/{key}", path, None, here, key, 0, child, record, f"{under}{key}"))
        elif isinstance(x, (list, tuple)):
            flat = None if any(isinstance(y, (dict, list, tuple)) for y in x) else json.dumps(list(x), ensure_ascii=False)
            yield path, parent, None, above, label, ordinal, "array", flat, record, field
            for i in range(len(x) - 1, -1, -1):
                todo.append((f"{path}/{i}", path, None, above, label, i, x[i], record, f"{field}_{i}" if field else str(i)))
        elif x is not None and entity is None:
            yield path, parent, None, above, label, ordinal, "scalar", _scalar(x), record, field


def latest(df: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """The last delivery of each key (ties: the largest values). Rows with a NULL key are left out."""
    rest = [c for c in columns if c != key]
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *rest)).alias("_last"))
    return last.select(key, "_last.*")


def adjacency(
    df: DataFrame,
    key: str,
    text: str,
    entities: Sequence[str],
    root: str = "lines",
    wrapper: str = "products",
) -> DataFrame:
    """The adjacency table of a column of JSON: ``key`` and ``NODES``.

    Parsing is the one step in Python (Arrow batches): the texts come from clients that write three
    dialects, of which Spark's JSON reader knows one. Rows whose text gives no value have no nodes.
    """
    entities = list(entities)
    kind = dict(df.dtypes)[key]
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    types = [src.schema["key"].dataType, *StructType.fromDDL(NODES)]
    schema = pa.schema([("key", to_arrow_type(types[0]))] + [(f.name, to_arrow_type(f.dataType)) for f in types[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list = []
            rows: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = len(rows)
                rows.extend(shred(parse(t), entities, root, wrapper))
                keys.extend([k] * (len(rows) - before))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([keys, *zip(*rows)], schema)], schema=schema)
                    keys, rows = [], []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([keys, *zip(*rows)], schema)], schema=schema)

    return src.mapInArrow(run, f"key {kind}, {NODES}").withColumnRenamed("key", key)


def entity_table(nodes: DataFrame, key: str, entity: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per object of ``entity`` with the scalars that belong to it as columns.

    ``fields`` maps a column to the fields it may have been written under; scalars of plain objects nested in
    the record belong to it too, as ``outer_inner``, and arrays of scalars as their JSON text. Output: ``key, node,
    parent, parent_entity, ordinal`` and the columns (text). Objects without scalars keep NULLs.
    """
    objects = nodes.where((F.col("kind") == "object") & (F.col("entity") == entity)).select(
        key, "node", "parent", "parent_entity", "ordinal"
    )
    known = [x for names in fields.values() for x in names]
    scalars = (
        nodes.where(F.col("scalar").isNotNull() & F.col("field").isin(known))
        .groupBy(key, F.col("record").alias("node"))
        .agg(*[F.max(F.when(F.col("field").isin(list(names)), F.col("scalar"))).alias(c) for c, names in fields.items()])
    )
    return objects.join(scalars, [key, "node"], "left")
