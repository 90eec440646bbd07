"""Filling containers of fixed token capacity with texts (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import VOCABULARY, encoder
from millrace.runtime import cut

ITEMS = "pack_name string, capacity int, doc_id bigint, piece_no int, char_start int, char_end int, tokens int"
PLACED = f"{ITEMS}, container string, used int"


def capacities(sizes: DataFrame, most: int = 1000) -> dict[str, int]:
    """Capacity by name from a parameter table; more than ``most`` rows are refused. NULLs and sizes below 1 are ignored."""
    rows = sizes.select("pack_name", "capacity_tokens").na.drop().where("capacity_tokens > 0").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} capacities")
    return {r.pack_name: r.capacity_tokens for r in rows}


def pieces(text: str, capacity: int, path: str = VOCABULARY, ids: list[int] | None = None) -> list[tuple[int, int, int]]:
    """``(char_start, char_end, tokens)`` of the pieces of a text that do not exceed the capacity.

    A text that fits is one piece. A longer one is cut at token borders that are also character
    borders; each piece is counted by itself, since the tokens of a cut text can differ.
    """
    enc = encoder(path)
    ids = enc.encode_ordinary(text) if ids is None else ids
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))] if ids else []
    ends = np.cumsum([len(b) for b in enc.decode_tokens_bytes(ids)])
    raw = text.encode()
    starts_char = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char)])
    out, first, at, n = [], 0, 0, len(ids)
    while first < n:
        last = min(n, first + capacity)
        while True:
            end = int(ends[last - 1])
            if end == len(raw) or starts_char[end]:
                size = len(enc.encode_ordinary(raw[at:end].decode()))
                if size <= capacity:
                    break
            last -= 1
            if last == first:  # no border inside one character's tokens; capacities below four tokens only
                raise ValueError(f"a character of the text has more than {capacity} tokens")
        out.append((int(chars[at]), int(chars[end]), size))
        first, at = last, end
    return out


def items(docs: DataFrame, doc: str, text: str, capacities: Mapping[str, int], path: str = VOCABULARY) -> DataFrame:
    """What has to be packed, for each capacity: ``ITEMS``. Blank texts are packed, texts without tokens are not."""
    wanted = {name: int(c) for name, c in capacities.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["pack_name", "capacity", "doc_id", "piece_no", "char_start", "char_end", "tokens"]
        enc = encoder(path)
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                ids = enc.encode_ordinary(t)
                for name, c in wanted.items():
                    rows.extend((name, c, d, k, *p) for k, p in enumerate(pieces(t, c, path, ids)))
            yield pd.DataFrame(rows, columns=names)

    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").mapInPandas(run, ITEMS)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item and fill of each container, packed online by the sum-of-squares rule.

    ``levels[h]`` counts the open containers filled to ``h``. An item goes to the fill level (or into a
    new container) for which the sum of the squared counts of all partly filled levels becomes least;
    ties go to the fullest level. Full containers leave the array.
    """
    levels = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    where = np.empty(len(sizes), np.int64)
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        source = levels[: capacity - s + 1]
        change = 2 * (levels[s:] - source) + 2  # one container moves from level h to level h + s
        change[-1] = 1 - 2 * source[-1]  # it becomes full and counts no more
        change[source == 0] = far
        change[0] = 2 * levels[s] + 1 if s < capacity else 0  # a new container
        h = capacity - s - int(change[::-1].argmin())
        if h:
            levels[h] -= 1
            c = stacks[h].pop()
        else:
            c = len(fills)
            fills.append(0)
        fills[c] += s
        if fills[c] < capacity:
            levels[fills[c]] += 1
            stacks[fills[c]].append(c)
        where[i] = c
    return where, np.array(fills, np.int64)


def _pack_groups(rows: DataFrame, round_no: int, group_items: int) -> DataFrame:
    counts = {r.pack_name: r.n for r in rows.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = F.coalesce(*[F.when(F.col("pack_name") == k, F.lit(max(1, -(-n // group_items)))) for k, n in counts.items()], F.lit(1))
    keyed = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(round_no)), groups).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        where, fills = sum_of_squares(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
        name = f"{pdf['pack_name'].iloc[0]}-{round_no}-{pdf['grp'].iloc[0]}-"
        out = pdf.drop(columns="grp")
        out["container"] = [f"{name}{c}" for c in where]
        out["used"] = fills[where]
        return out

    return keyed.groupBy("pack_name", "grp").applyInPandas(run, PLACED)


def pack(rows: DataFrame, group_items: int = 20_000, slack: float = 0.005, rounds: int = 3) -> DataFrame:
    """Pack ``ITEMS`` into containers: ``PLACED``, one row per item.

    Items are dealt by hash to groups of about ``group_items``; each group is packed online by the
    sum-of-squares rule, its items arriving by falling size. A group leaves a few containers with
    more than ``slack`` of their capacity unused; in up to ``rounds`` - 1 further rounds the items of
    those alone are dealt to far fewer groups and packed again. So the waste does not grow with the
    number of groups, and no task holds more than a group.
    """
    done = None
    rest = rows
    for k in range(rounds):
        placed = cut(_pack_groups(rest, k, group_items))
        open_ = (F.col("capacity") - F.col("used")) > slack * F.col("capacity")
        last = k == rounds - 1
        closed = placed if last else placed.where(~open_)
        done = closed if done is None else done.unionByName(closed)
        if not last:
            rest = placed.where(open_).drop("container", "used")
            if rest.isEmpty():
                break
    return done


def packed_texts(
    docs: DataFrame, doc: str, text: str, capacities: Mapping[str, int], path: str = VOCABULARY, **settings
) -> DataFrame:
    """Containers with their texts: ``pack_name, container, capacity_tokens, used_tokens, unused_tokens,
    doc_id, piece_no, tokens, text``, one row per text or piece of a text.

    Every text with tokens appears once per capacity; only longer texts are cut, and their pieces put
    together are the text. Exact copies under other ids are texts of their own. An empty table and
    texts that are NULL or empty give no rows. ``docs`` is joined once, with its placements folded.
    """
    placed = pack(cut(items(docs, doc, text, capacities, path)), **settings)
    folded = placed.groupBy("doc_id").agg(
        F.collect_list(F.struct("pack_name", "container", "capacity", "used", "piece_no", "char_start", "char_end", "tokens")).alias("p")
    )
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("_text")).join(folded, "doc_id")
    return rows.select("doc_id", "_text", F.explode("p").alias("p")).select(
        "p.pack_name", "p.container", F.col("p.capacity").alias("capacity_tokens"), F.col("p.used").alias("used_tokens"),
        (F.col("p.capacity") - F.col("p.used")).alias("unused_tokens"), "doc_id", "p.piece_no", "p.tokens",
        F.substring(F.col("_text"), F.col("p.char_start") + 1, F.col("p.char_end") - F.col("p.char_start")).alias("text"),
    )


def containers(placed: DataFrame) -> DataFrame:
    """One row per container of ``packed_texts``: its size, number of texts and unused space."""
    return placed.groupBy("pack_name", "container").agg(
        F.max("capacity_tokens").alias("capacity_tokens"), F.sum("tokens").alias("used_tokens"),
        (F.max("capacity_tokens") - F.sum("tokens")).alias("unused_tokens"), F.count(F.lit(1)).alias("texts"),
    )
