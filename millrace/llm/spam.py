"""Pages made of repeated keywords, links, tags and listings rather than sentences (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.listing import pieces

SHINGLE = 5
"""Words in a phrase; an item of fewer words is a phrase as a whole."""
WEIGHTS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 2**64)) for i in range(SHINGLE)]
GAP = (0,) * (SHINGLE - 1)
FOLDED = 1_500_000
"""Words after which a task hands on the phrases that it has folded."""

MOST = 2**21 - 1
"""Characters that one entry can hold; what a phrase covers beyond them takes further entries of the same page."""
SCHEMA = pa.schema([pa.field("phrase", pa.int64(), False), pa.field("entries", pa.list_(pa.int64()))])


class Hashes(dict):
    """Words and their 64-bit hashes, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        v = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return v


class Folder:
    """Collects the phrases of documents and folds them: one row per phrase with all documents that hold it.

    ``entries`` alternates a document and a number that says which host it is of (39 bits of a hash), how many of
    its characters the phrase covers (21 bits), whether these are mostly list-like (4), and whether the phrase
    stands there in a decided list (1) or a decided statement (2). The documents' own sums travel in rows of
    their own, as negative numbers: size and listed characters, each less 1.
    """

    def __init__(self) -> None:
        self.known = Hashes()
        self.clear()

    def clear(self) -> None:
        self.hashes: list[int] = []
        self.starts: list[int] = []
        self.items: list[tuple[int, int, int, int]] = []  # document, phrases, characters, kind
        self.docs: list[int] = []
        self.hosts: list[int] = []
        self.size: list[int] = []
        self.listed: list[int] = []

    def add(self, doc: int, host: int, text: str | None) -> None:
        known, hashes, at = self.known.__getitem__, self.hashes, len(self.docs)
        size = listed = 0
        for words, chars, is_list, decided in pieces(text):
            if words:
                n = max(1, len(words) - SHINGLE + 1)
                chars = max(n, chars // n * n)
                self.starts.append(len(hashes))
                self.items.append((at, n, chars // n, (4 if is_list else 0) | (0 if not decided else 1 if is_list else 2)))
                hashes.extend(map(known, words))
                hashes.extend(GAP)
            size += chars
            listed += chars if is_list else 0
        self.docs.append(doc)
        self.hosts.append(host)
        self.size.append(size)
        self.listed.append(listed)

    def full(self) -> bool:
        return len(self.hashes) > FOLDED

    def fold(self) -> Iterator[pa.RecordBatch]:
        """The rows collected so far."""
        if self.docs:
            yield self._sums()
        if self.items:
            yield self._phrases()
        self.clear()

    def _sums(self) -> pa.RecordBatch:
        n = len(self.docs)
        doc = np.array(self.docs, "int64")
        entries = np.stack([doc, -1 - np.array(self.size, "int64"), doc, -1 - np.array(self.listed, "int64")], 1)
        return self._batch((doc.view("uint64") * WEIGHTS[0]).view("int64"), np.arange(n + 1) * 4, entries)

    def _phrases(self) -> pa.RecordBatch:
        h = np.array(self.hashes, "uint64")
        rolled = np.zeros(len(h) - SHINGLE + 1, "uint64")
        for i, m in enumerate(WEIGHTS):
            rolled += h[i : i + len(rolled)] * m
        item = np.array(self.items, "int64")
        counts = item[:, 1]
        first = np.repeat(np.array(self.starts, "int64") - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        phrase = rolled[first + np.arange(counts.sum())].view("int64")
        doc, chars, state = (np.repeat(item[:, i], counts) for i in (0, 2, 3))
        order = np.lexsort((doc, phrase))
        phrase, doc, chars, state = phrase[order], doc[order], chars[order], state[order]
        pair = np.flatnonzero(np.concatenate([[True], (phrase[1:] != phrase[:-1]) | (doc[1:] != doc[:-1])]))
        total = np.add.reduceat(chars, pair)
        listed = np.add.reduceat(np.where(state & 4, chars, 0), pair)
        seen = np.bitwise_or.reduceat(state & 3, pair)
        flags = np.where(listed * 2 > total, 4, 0) + seen
        phrase, doc = phrase[pair], doc[pair]
        if total.max() > MOST:
            times = -(-total // MOST)
            last = np.cumsum(times) - 1
            phrase, doc, flags = np.repeat(phrase, times), np.repeat(doc, times), np.repeat(flags, times)
            rest = total - (times - 1) * MOST
            total = np.full(len(phrase), MOST)
            total[last] = rest
        host = np.array(self.hosts, "int64")[doc] & (2**39 - 1)
        entries = np.stack([np.array(self.docs, "int64")[doc], host << 24 | total << 3 | flags], 1)
        heads = np.flatnonzero(np.concatenate([[True], phrase[1:] != phrase[:-1]]))
        return self._batch(phrase[heads], np.append(heads, len(phrase)) * 2, entries)

    @staticmethod
    def _batch(key: np.ndarray, bounds: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype("int32")), pa.array(entries.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(key), lists], schema=SCHEMA)


def phrases(docs: DataFrame, doc: str, text: str, host: str) -> DataFrame:
    """The phrases of whole texts and the sums of the documents: ``phrase, entries`` (see ``Folder``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for b in batches:
            for d, h, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                folder.add(d, h, t)
                if folder.full():
                    yield from folder.fold()
        yield from folder.fold()

    rows = docs.select(
        F.col(doc).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(host), F.lit(""))).alias("host"), F.col(text).alias("text")
    ).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "phrase bigint NOT NULL, entries array<bigint>")


def host_counts(grams: DataFrame, hosts: int) -> DataFrame:
    """Phrases that ``hosts`` or more distinct hosts hold: ``phrase, hosts, in_lists, in_statements``.

    ``in_lists`` and ``in_statements`` are the numbers of hosts that use the phrase so.
    """
    each = grams.select("phrase", F.posexplode_outer("entries").alias("at", "entry")).where("at % 2 = 1 AND entry >= 0")
    held = each.groupBy("phrase", F.shiftright("entry", 24).alias("host")).agg(F.bit_or("entry").alias("seen"))
    return held.groupBy("phrase").agg(
        F.count(F.lit(1)).alias("hosts"), F.count_if(F.col("seen").bitwiseAND(1) > 0).alias("in_lists"),
        F.count_if(F.col("seen").bitwiseAND(2) > 0).alias("in_statements"),
    ).where(F.col("hosts") >= hosts)


def score_pages(docs: DataFrame, doc: str, text: str, host: str, hosts: int = 3) -> DataFrame:
    """How spammy each page is: ``doc_id, density, score``.

    Texts are cut into lines and sentences and these at their separators; every five words in a row of
    such an item are a phrase, and so is a shorter item. For each phrase the distinct hosts are counted that
    hold it anywhere, that hold it in something list-like and that hold it in statements, over the whole
    texts of all documents. Where ``hosts`` or more hold a phrase and more than half of them (the page's own
    left out) use it in lists, it is material that list pages are stitched from, and where more than half use it in statements
    it is ordinary speech, whatever it looks like on the page itself. The page's own look decides for the other phrases.

    ``density`` is the share of the page that looks like lists, ``score`` the share after the phrases have
    been heard; a page is spam if that is more than half of it. A host counts once per phrase, however many
    pages it has. NULL and blank texts have score 0; a NULL host is one host; repeated rows of a doc_id
    are one page. The phrases are shuffled once, folded by task before; both the counts and
    the verdicts are taken from that layout. A phrase has at most one entry a page, so one that a third
    of all pages hold is still a small part of the entries.
    """
    grams = phrases(docs, doc, text, host).repartition("phrase")
    told = host_counts(grams, hosts)
    e = F.col("entry")
    found = grams.join(told.hint("merge"), "phrase", "left").select("entries", "hosts", "in_lists", "in_statements", F.posexplode_outer("entries").alias("at", "entry"))
    lists = F.col("in_lists") - e.bitwiseAND(1)
    states = F.col("in_statements") - F.shiftright(e.bitwiseAND(2), 1)
    others = F.col("hosts") - 1
    looks = e.bitwiseAND(4) > 0
    chars = F.shiftright(e, 3).bitwiseAND(MOST)
    moved = F.when(e >= 0, F.when((lists * 2 > others) & ~looks, chars).when((states * 2 > others) & looks, -chars))
    rows = found.where((F.col("at") % 2 == 1) & ((e < 0) | moved.isNotNull())).select(
        F.get("entries", F.col("at") - 1).alias("doc_id"), F.when((e < 0) & (F.col("at") == 1), -1 - e).alias("size"),
        F.when((e < 0) & (F.col("at") == 3), -1 - e).alias("listed"), moved.alias("moved"),
    )
    sums = rows.groupBy("doc_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "listed", "moved")])
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col("size")), F.lit(0.0))
    return sums.select("doc_id", share(F.col("listed")).alias("density"), share(F.least(F.greatest(F.col("listed") + F.col("moved"), F.lit(0)), F.col("size"))).alias("score"))


def spam_pages(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "site", threshold: float = 0.5) -> DataFrame:
    """The pages that are spam: ``doc_id``."""
    return score_pages(docs, doc, text, host).where(F.col("score") > threshold).select("doc_id")
