"""Splitting fields that hold several values behind inconsistent delimiters (problem 4)."""

from __future__ import annotations

import ast
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import hot_keys, salted_join
from millrace.runtime import cut

# What stands in a list for "nobody known", in lower case.
NOBODY = frozenset(
    ["", "-", "--", "?", ".", "n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "unknown", "undisclosed",
     "not disclosed", "not available", "tbd", "tba", "no investors"]
)

BLANK = " \t\r\n\f\v\u00a0\u2007\u202f\u200b\ufeff"
HARD = ";|\n\r\t"
"""Delimiters that no name contains; commas, slashes, "and" and "&" may be part of a name."""

_SPACE = r"[\s\u00a0\u2007\u202f\u200b\ufeff]"
_SOFT = re.compile(
    rf"(?P<comma_and>{_SPACE}*,{_SPACE}*(?:and|&){_SPACE}+)|(?P<comma>{_SPACE}*,{_SPACE}*)"
    rf"|(?P<slash>{_SPACE}+/{_SPACE}*|/{_SPACE}+)|(?P<tight_slash>/)"
    rf"|(?P<and>{_SPACE}+and{_SPACE}+)|(?P<amp>{_SPACE}*&{_SPACE}*)"
)
_EDGE = re.compile(rf"^(?:{_SPACE}|[,/])*(?:(?:and|&)(?:{_SPACE}+|$))?|(?:(?:{_SPACE}|[,/])(?:and|&))?(?:{_SPACE}|[,/])*$")
_STOP = rf"(?={_SPACE}*(?:[,;|/\n\r\t]|(?:and|&){_SPACE}|$))"
_QUOTED = re.compile(rf'"((?:[^"\\]|""|\\.)*)"{_STOP}' + "|" + rf"'((?:[^'\\]|''|\\.|'(?=\w))*)'{_STOP}")

@dataclass(frozen=True)
class Segmentation:
    """Parameters: ``parts`` is the number of pieces a name may be made of at least (more if a quoted name of
    the column has more), ``rounds`` the EM rounds."""

    parts: int = 6
    rounds: int = 4
    discount: float = 0.15
    unseen: float = 0.1
    inner: float = 0.02
    backing: float = 2.0


# Where EM starts: the probability that a delimiter of a kind separates two names.
START = {"comma_and": 0.95, "comma": 0.9, "slash": 0.9, "tight_slash": 0.05, "and": 0.2, "amp": 0.1}
SALTS = 32
KINDS = {k: i for i, k in enumerate(START, 1)}


def _trim(text: str) -> str:
    return text.strip(BLANK)


def _unquote(double: str | None, single: str | None) -> str:
    text, quote = (double, '"') if double is not None else (single, "'")
    return re.sub(r"\\(.)", r"\1", text.replace(quote * 2, quote))


def _opens(gap: str, first: bool) -> bool:
    """Whether a quote after ``gap`` (what stands since the last quoted span) starts a name: a delimiter comes before it."""
    bare = gap.rstrip(BLANK)
    after = gap[len(bare) :]
    if not bare:
        return first or not gap or not set(after).isdisjoint("\n\r\t")
    if bare[-1] in ",;|/" or not set(after).isdisjoint("\n\r\t"):
        return True
    word = "and" if bare.endswith("and") else "&" if bare.endswith("&") else None
    if word is None:
        return False
    head = bare[: -len(word)]
    return bool(head and head[-1] in BLANK) or bool(after and (not head or head[-1] in ",;|/"))


def segments(text: str | None) -> list[tuple[str, bool]]:
    """The parts of a field that are certain to be apart: ``(text, atomic)`` in order.

    Quoted spans and the elements of a JSON or Python list are atomic. Elsewhere the field is cut at
    the hard delimiters only. Blank parts and placeholders are left out.
    """
    if text is None:
        return []
    bare = _trim(text)
    if bare[:1] == "[" and bare[-1:] == "]":
        for read in (json.loads, ast.literal_eval):
            try:
                items = read(bare)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
            names = [_trim(str(x)) for x in items if x is not None]
            return [(x, True) for x in names if x.casefold() not in NOBODY]
        bare = _trim(bare[1:-1])
    out: list[tuple[str, bool]] = []

    def loose(part: str) -> None:
        for piece in re.split(f"[{HARD}]+", part):
            piece = _trim(_EDGE.sub("", _trim(piece)))
            if piece.casefold() not in NOBODY:
                out.append((piece, False))

    begin = 0
    for m in _QUOTED.finditer(bare):
        if not _opens(bare[begin : m.start()], begin == 0):
            continue
        loose(bare[begin : m.start()])
        name = _trim(_unquote(m.group(1), m.group(2)))
        if name.casefold() not in NOBODY:
            out.append((name, True))
        begin = m.end()
    loose(bare[begin:])
    return out


class Lattice:
    """The pieces of a segment between soft delimiters and every name they could form."""

    def __init__(self, text: str, parts: int):
        spans, kinds, at = [], [], 0
        for m in _SOFT.finditer(text):
            if m.start() > at:
                spans.append((at, m.start()))
                kinds.append(m.lastgroup)
                at = m.end()
            elif kinds:
                kinds[-1], at = "comma", m.end()
            else:
                at = m.end()
        if at < len(text):
            spans.append((at, len(text)))
        else:
            kinds = kinds[: max(0, len(spans) - 1)]
        self.n, self.kinds = len(spans), kinds
        self.edges = [(i, j) for i in range(self.n) for j in range(i + 1, min(self.n, i + parts) + 1)]
        self.values = [_trim(text[spans[i][0] : spans[j - 1][1]]) for i, j in self.edges]
        self.nexts = [text[s:e] for s, e in spans[1:]]

    def keys(self) -> list[str]:
        """Model keys: one per candidate name, then one per delimiter with the piece that follows it.

        The first character is 0 for a name and else the kind of the delimiter, counted from 1.
        """
        return [f"0{v}" for v in self.values] + [f"{KINDS[k]}{w}" for k, w in zip(self.kinds, self.nexts)]

    def _scores(self, known: list[float], start: dict[str, float], total: float, s: Segmentation):
        m = len(self.edges)
        cut_at = []
        for kind, p in zip(self.kinds, known[m:]):
            p = min(max(start[kind] if p is None or p != p else p, 1e-6), 1 - 1e-6)
            cut_at.append((math.log(p), math.log1p(-p)))
        # An unseen name costs as much as its pieces would; a piece that usually stays attached costs little.
        joined = [0.1 * math.exp(no) if no > math.log(0.5) else s.inner * s.unseen / max(total, 1.0) for _, no in cut_at]
        scores = []
        for (i, j), count in zip(self.edges, known[:m]):
            score = 0.0  # before anything is learned only the delimiters count
            if total:
                count = 0.0 if count is None or count != count else count
                score = math.log((count + s.unseen * math.prod(joined[i : j - 1])) / total)
            score += sum(cut_at[k][1] for k in range(i, j - 1)) + (cut_at[j - 1][0] if j < self.n else 0.0)
            scores.append(score)
        return scores

    def expect(self, known, start, total, s) -> tuple[list[float], list[float]]:
        """Forward-backward: the probability of each candidate name and of a cut at each delimiter."""
        scores = self._scores(known, start, total, s)
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -1e300 else max(a, b)
        fwd, bwd = [0.0] + [-1e301] * self.n, [-1e301] * self.n + [0.0]
        for (i, j), x in sorted(zip(self.edges, scores), key=lambda e: e[0][1]):
            fwd[j] = add(fwd[j], fwd[i] + x)
        for (i, j), x in sorted(zip(self.edges, scores), key=lambda e: -e[0][0]):
            bwd[i] = add(bwd[i], bwd[j] + x)
        stay = [1 - min(max(start[k] if p is None or p != p else p, 0.0), 1.0) for k, p in zip(self.kinds, known[len(self.edges) :])]
        # A joined name counts as far as its delimiters are known to stay; chance neighbours do not add up to a name.
        names = [
            math.exp(fwd[i] + x + bwd[j] - fwd[self.n]) * math.prod(stay[i : j - 1]) for (i, j), x in zip(self.edges, scores)
        ]
        cuts = [math.exp(fwd[k] + bwd[k] - fwd[self.n]) for k in range(1, self.n)]
        return names, cuts

    def best(self, known, start, total, s) -> list[str]:
        """Viterbi: the names of the likeliest split."""
        scores = self._scores(known, start, total, s)
        top: list = [(0.0, None)] + [(-math.inf, None)] * self.n
        for e in sorted(range(len(self.edges)), key=lambda e: self.edges[e][1]):
            i, j = self.edges[e]
            if top[i][0] + scores[e] > top[j][0]:
                top[j] = (top[i][0] + scores[e], e)
        names, at = [], self.n
        while at:
            e = top[at][1]
            names.append(self.values[e])
            at = self.edges[e][0]
        return names[::-1]


def _soft(text: str) -> bool:
    return _SOFT.search(text) is not None


def _segments_udf():
    @F.pandas_udf("array<struct<text:string,kind:string>>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [{"text": x, "kind": "name" if atomic or not _soft(x) else "soft"} for x, atomic in segments(t)]
        )

    return cut_up


def _keys(texts, parts: int):
    """The model keys of segments as numbers: a hash whose last three bits say what the key is of."""

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: Lattice(t, parts).keys())

    return F.transform(keys(texts), _number)


def _number(key):
    return F.xxhash64(key).bitwiseAND(F.lit(-8)).bitwiseOR(F.substring(key, 1, 1).cast("bigint"))


def _known(soft: DataFrame, model: DataFrame | None, hot: list[int]) -> DataFrame:
    """Segments (``seg, text, weight, keys``) with what the model knows about their keys, in the order of the keys.

    ``hot`` keys (fewer than ``skew.HOT_KEYS``) are spread over ``SALTS`` tasks.
    """
    if model is None:
        return soft.withColumn("known", F.lit(None).cast("array<double>"))
    flat = soft.select("seg", F.posexplode("keys").alias("at", "key"))
    on = ["key"]
    if hot:
        on, is_hot = ["key", "salt"], F.col("key").isin(hot)
        flat = flat.withColumn("salt", F.when(is_hot, F.pmod("seg", F.lit(SALTS)).cast("int")).otherwise(0))
        model = model.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    got = flat.join(model, on, "left").groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("k"))
    return soft.join(got, "seg").select("seg", "text", "weight", "keys", F.col("k.p").alias("known"))


def learn(soft: DataFrame, names: DataFrame, hot: list[int], s: Segmentation, parts: int) -> tuple[DataFrame | None, dict[str, float], float]:
    """Expectation-maximisation over all segments: value frequencies and what each delimiter does.

    The model is a table ``key, p``: discounted expected counts of values, and for a delimiter with
    the piece after it the probability of a cut (backed off to the delimiter's kind; before the
    last piece of a quoted name it is known to stay). Only the six
    probabilities by kind and the total come to the driver.
    """
    base = cut(names.groupBy(_number(F.concat(F.lit("0"), "text")).alias("key")).agg(F.sum("weight").cast("double").alias("p")))
    sure = base.agg(F.sum("p")).first()[0] or 0.0

    @F.pandas_udf("string")
    def last(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (Lattice(t, 1).keys() or [None])[-1])

    ends = names.where(F.col("text").rlike("[,/&]|(?i)and")).select(last("text").alias("key"), "weight").where("key NOT LIKE '0%'")
    stays = cut(ends.groupBy(_number(F.col("key")).alias("key")).agg(F.sum("weight").cast("double").alias("kept")))
    model, start, total = None, dict(START), 0.0
    for _ in range(s.rounds):

        def expect(batches: Iterator[pd.DataFrame], start=start, total=total) -> Iterator[pd.DataFrame]:
            for b in batches:
                ns, cs = [], []
                for text, weight, known in zip(b["text"], b["weight"], b["known"]):
                    lat = Lattice(text, parts)
                    known = [None] * (len(lat.edges) + len(lat.kinds)) if known is None else list(known)
                    given, apart = lat.expect(known, start, total, s)
                    ns.append([p * weight for p in given] + [weight] * len(apart))
                    cs.append([float(j - i > 1) for i, j in lat.edges] + [p * weight for p in apart])
                yield pd.DataFrame({"keys": b["keys"], "n": ns, "c": cs})

        told = _known(soft, model, hot).mapInPandas(expect, "keys array<bigint>, n array<double>, c array<double>")
        flat = told.select(F.inline(F.arrays_zip("keys", "n", "c"))).withColumnRenamed("keys", "key")
        sums = cut(flat.groupBy("key").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("c").alias("inner")))
        kind = F.col("key").bitwiseAND(F.lit(7))
        cuts = sums.where(kind > 0).withColumn("kind", kind)
        by_kind = {r.kind: (r.n, r.c) for r in cuts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()}
        start = {k: (by_kind.get(i, (0, 0))[1] + 5 * START[k]) / (by_kind.get(i, (0, 0))[0] + 5) for k, i in KINDS.items()}
        prior = F.create_map(*[F.lit(x) for k, i in KINDS.items() for x in (i, start[k])])[F.col("kind").cast("int")]
        values = sums.where(kind == 0).select(
            "key", F.when(F.col("inner") > 0, F.greatest(F.col("n") - s.discount, F.lit(0.0))).otherwise(F.col("n")).alias("p")
        )
        counted = values.unionByName(base).groupBy("key").agg(F.sum("p").alias("p"))
        total = sure + (values.agg(F.sum("p")).first()[0] or 0.0) + 1.0
        model = cut(
            counted.unionByName(
                cuts.join(stays, "key", "left").select(
                    "key", ((F.col("c") + s.backing * prior) / (F.col("n") + F.coalesce("kept", F.lit(0.0)) + s.backing)).alias("p")
                )
            )
        )
    return model, start, total


def split_packed(df: DataFrame, key: str, text: str, settings: Segmentation = Segmentation()) -> DataFrame:
    """One row per value: ``key, position_no, value``; positions count from 1 within the field.

    Fields are cut where that is certain (hard delimiters, quotes, list syntax). What remains may hold
    delimiters that are part of a name; those segments become lattices of candidate names. EM learns
    from the whole column how often each name occurs and whether a delimiter in front of a piece
    separates, and Viterbi takes the likeliest split. Equal segments are handled once; names and segments
    that hold more than a hundredth of their table are spread by salts.

    Repeated rows count once; NULL, blank and placeholder values give no row; a value listed twice
    gives two rows. An empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL").distinct()
    pieces = cut(
        rows.select("key", F.xxhash64("text").alias("field"), F.posexplode(_segments_udf()("text")).alias("pos", "x"))
        .select("key", "field", "pos", F.xxhash64("x.text").alias("seg"), "x.text", "x.kind")
    )
    weights = pieces.groupBy("seg", "kind").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("weight"))
    weights = cut(weights)
    names = weights.where("kind = 'name'")

    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: Lattice(t, 1).n)

    most = names.where(F.col("text").rlike("[,/&]|(?i)and")).agg(F.max(size("text"))).first()[0] or 0
    parts = max(settings.parts, most)
    soft = cut(weights.where("kind = 'soft'").select("seg", "text", "weight", _keys(F.col("text"), parts).alias("keys")))
    hot = [r.key for r in hot_keys(soft.select(F.explode("keys").alias("key")), ["key"]).collect()]  # fewer than HOT_KEYS
    model, start, total = learn(soft, names, hot, settings, parts)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = []
            for t, known in zip(b["text"], b["known"]):
                lat = Lattice(t, parts)
                names.append(lat.best([None] * (len(lat.edges) + len(lat.kinds)) if known is None else list(known), start, total, settings))
            yield pd.DataFrame({"seg": b["seg"], "names": names})

    solved = _known(soft, model, hot).mapInPandas(solve, "seg bigint, names array<string>")
    found = pieces.where("kind = 'name'").select("key", "field", "pos", F.array("text").alias("names")).unionByName(
        salted_join(pieces.where("kind = 'soft'").drop("text", "kind"), solved, ["seg"]).select("key", "field", "pos", "names")
    )
    flat = found.select("key", "field", "pos", F.posexplode("names").alias("at", "value")).where(~F.lower("value").isin(sorted(NOBODY)))
    place = Window.partitionBy("key", "field").orderBy("pos", "at")
    return flat.select(F.col("key").alias(key), F.row_number().over(place).alias("position_no"), "value")
