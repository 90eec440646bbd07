"""Mixing sources to target shares of all tokens (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import VOCABULARY, token_counts
from millrace.runtime import cut

NO_SOURCE = ""


@dataclass(frozen=True)
class Mixing:
    """Parameters: the classifier is fitted on about ``sample`` labelled rows per source; ``block`` is the
    number of documents rounded together; ``steps`` and ``close`` end the gradient steps."""

    sample: int = 300
    features: int = 2048
    block: int = 2000
    steps: int = 30
    close: float = 1e-4
    seed: int = 17


class DomainModel:
    """Multinomial logistic regression from hashed words to sources, fitted on a bounded labelled sample."""

    def __init__(self, docs: DataFrame, text: str, source: str, s: Mixing = Mixing(), counts: dict[str, int] | None = None):
        """``counts``: the number of rows of each source where that is known already."""
        rows = docs.select(F.col(text).alias("_text"), F.col(source).alias("_source")).where("_text IS NOT NULL AND _source IS NOT NULL")
        if counts is None:
            counts = {r._source: r["count"] for r in rows.groupBy("_source").count().collect()}  # one row per source
        self.sources: list[str] = []
        self._fitted = None
        if len(counts) < 2:
            self.sources = list(counts)
            return
        share = {k: min(1.0, s.sample / n) for k, n in counts.items()}
        of = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("_source")]
        dice = F.pmod(F.xxhash64("_text", F.lit(s.seed)), F.lit(1_000_000)) / 1_000_000.0
        sample = cut(rows.where(dice < of))
        stages = [
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=s.features, binary=True),
        ]
        labels = StringIndexer(inputCol="_source", outputCol="_label", stringOrderType="alphabetAsc")
        fit = LogisticRegression(featuresCol="_tf", labelCol="_label", maxIter=15, regParam=0.02, family="multinomial")
        self._fitted = Pipeline(stages=[labels, *stages, fit]).fit(sample)
        self.sources = list(self._fitted.stages[0].labels)
        self.weights = [1.0 / share[x] for x in self.sources]
        self._fitted.stages[0].setHandleInvalid("keep")

    def posterior(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        """Add ``name``: the probability of each of ``self.sources``; NULL texts count as blank."""
        if self._fitted is None:
            return docs.withColumn(name, F.array(*[F.lit(1.0) for _ in self.sources]).cast("array<double>"))
        out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        for stage in self._fitted.stages[1:]:
            out = stage.transform(out)
        # The sample holds frequent sources less often than the corpus does, so their odds are raised again.
        odds = F.zip_with(vector_to_array("probability"), F.array(*[F.lit(w) for w in self.weights]), lambda p, w: p * w)
        total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
        return out.withColumn(name, F.transform(odds, lambda x: x / total)).drop("_text", "_words", "_tf", "rawPrediction", "probability", "prediction")


def _steps(m: np.ndarray, cap: np.ndarray, history: list[np.ndarray], start: float) -> np.ndarray:
    """The rates after the projected gradient steps so far: each step is kept within 0 and the cap."""
    r = np.minimum(start * m.sum(axis=1), cap)
    for g in history:
        r = np.clip(r - m @ g, 0.0, cap)
    return r


def fit_rates(cells: DataFrame, targets: dict[str, pd.DataFrame], s: Mixing) -> dict[str, dict]:
    """Projected-gradient least squares for the rates of all documents of every mix.

    ``cells`` has ``mix_name, m (soft membership over the mix's sources), cap, tokens``: documents that
    agree in membership and cap always have the same rate and are one cell. The loss is the sum over
    sources of (expected tokens - target)^2 / available tokens; a step is its gradient per token of
    the document. All documents start at one rate (times what of them belongs to the mix), the mix's tokens by those of its
    candidates, whatever the targets; the steps alone bring them to the targets. A mix is as large as the labelled
    documents of its scarcest source allow at their cap, so the optimum is within reach; steps end when the sources are
    off by ``close`` of the total in sum, or after ``steps`` (what is left is ``off``). A step needs the sources' expected tokens only, one small sum per mix; the rates
    themselves stay with the executors and are derived from the steps so far.
    """
    cells = cut(cells)
    state: dict[str, dict] = {}
    base = cells.select("mix_name", "tokens", F.posexplode("m").alias("k", "p")).groupBy("mix_name", "k").agg(F.sum(F.col("p") * F.col("tokens")).alias("available"))
    found = base.collect()  # one row per mix and source
    for mix, t in targets.items():
        k = len(t)
        available = np.zeros(k)
        for r in found:
            if r.mix_name == mix:
                available[r.k] = r.available
        most = t["hard_tokens"].to_numpy(dtype="float64") * t["max_repeats"].to_numpy(dtype="float64")
        share = np.where(t["hard_tokens"].to_numpy() > 0, t["target_share"].to_numpy(), 0.0)
        share = share / share.sum() if share.sum() > 0 else share
        used = share > 0
        total = float(np.min(most[used] / share[used])) if used.any() else 0.0
        wanted = total * share
        start = float(total / max(available.sum(), 1e-9))
        state[mix] = {"wanted": wanted, "available": available, "start": start, "history": [], "done": not used.any(), "off": 0.0}
    for _ in range(s.steps):
        if all(x["done"] for x in state.values()):
            break
        frozen = {mix: (x["start"], list(x["history"])) for mix, x in state.items()}

        def sums(batches: Iterator[pd.DataFrame], frozen=frozen) -> Iterator[pd.DataFrame]:
            for b in batches:
                for mix, g in b.groupby("mix_name"):
                    m = np.stack(g["m"].to_numpy())
                    r = _steps(m, g["cap"].to_numpy(), frozen[mix][1], frozen[mix][0])
                    got = (r * g["tokens"].to_numpy()) @ m
                    yield pd.DataFrame({"mix_name": mix, "k": np.arange(len(got), dtype="int32"), "got": got})

        got = cells.mapInPandas(sums, "mix_name string, k int, got double").groupBy("mix_name", "k").agg(F.sum("got").alias("got")).collect()
        for mix, x in state.items():
            if x["done"]:
                continue
            now = np.zeros(len(x["wanted"]))
            for r in got:
                if r.mix_name == mix:
                    now[r.k] = r.got
            off = now - x["wanted"]
            x["expected"], x["off"] = now, float(np.abs(off).sum() / max(x["wanted"].sum(), 1.0))
            if x["off"] <= s.close:
                x["done"] = True
            else:
                x["history"].append(np.where(x["available"] > 0, off / np.maximum(x["available"], 1e-9), 0.0))
    return state


def whole_copies(rates: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whole numbers of copies whose tokens come as close to the rates' as one block allows.

    Every document gets the whole part of its rate. Of the rest, documents are taken in the given order
    whenever at least half of one is owed, so long and short texts have the same chances; what is
    still owed at the end is settled by the text whose size fits it best.
    """
    base = np.floor(rates + 1e-9)
    part = np.clip(rates - base, 0.0, 1.0)
    extra = np.zeros(len(rates))
    owed = 0.0
    for i in range(len(rates)):
        owed += part[i] * tokens[i]
        if part[i] > 0 and owed >= tokens[i] / 2:
            extra[i] = 1
            owed -= tokens[i]
    while len(rates):  # every pass brings ``owed`` nearer to 0, so this ends
        change = np.where(part <= 0, np.inf, np.abs(owed - np.where(extra > 0, -tokens, tokens)))
        i = int(change.argmin())
        if change[i] >= abs(owed) - 1e-9:
            break
        owed -= -tokens[i] if extra[i] else tokens[i]
        extra[i] = 1 - extra[i]
    return (base + extra).astype("int64")


def mix_documents(
    docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
    path: str = VOCABULARY, s: Mixing = Mixing(),
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents of every mix and the shares reached.

    First table: ``mix_name, doc_id, source, copies, tokens`` for documents used at least once.
    Second: ``mix_name, source, target_share, reached_share, labelled_share, planned_share, tokens,
    available_tokens, documents, max_repeats, steps, off`` (gradient steps of the mix, and by what part of the total the
    rates still missed). ``reached_share`` counts the chosen copies by membership,
    so a document without a source adds its parts to all sources; ``labelled_share`` and ``tokens`` count
    those only that name the source (the line without a source holds the others); ``planned_share`` is
    what the rates gave before they became whole copies.

    A document with a source belongs to it; one without belongs to every source by the posterior
    of a classifier fitted on a bounded sample of the labelled documents. A mix is made as large as its
    scarcest source allows at its cap. Rates of all documents are fitted by projected-gradient least
    squares and rounded to copies in blocks. A listed source without tokens cannot be
    reached: it is reported with share 0 and the others share its part in proportion. A document
    without a source is a candidate of every mix with its posterior as it stands: the part that falls to sources the mix
    does not list counts in the total and for none of its sources. It takes the cap of its likeliest listed source. Texts without tokens are not chosen. Targets with NULL fields are ignored. Target tables are parameters and come
    to the driver; more than 10,000 rows are refused.
    """
    rows = targets.select("mix_name", "source", "target_share", "max_repeats").na.drop().limit(10_001).toPandas()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 targets")
    rows = rows.drop_duplicates(["mix_name", "source"]).sort_values(["mix_name", "source"])
    spark = docs.sparkSession
    src = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    src = src.where("doc_id IS NOT NULL AND text IS NOT NULL")
    sized = cut(token_counts(src, ["doc_id", "source"], "text", path).where("tokens > 0"))
    per_source = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    hard, labelled = {r.source: r.t for r in per_source}, {r.source: r.n for r in per_source}
    model = DomainModel(src, "text", "source", s, labelled)
    soft = model.posterior(src.where("source IS NULL"), "text", "posterior").select("doc_id", "posterior")
    nameless = sized.where("source IS NULL").join(soft, "doc_id").select("doc_id", "tokens", "posterior")

    by_mix = {mix: t.reset_index(drop=True).assign(hard_tokens=[hard.get(x, 0) for x in t["source"]]) for mix, t in rows.groupby("mix_name", sort=True)}
    lines = [
        (mix, r.source, i, float(r.max_repeats), [float(i == j) for j in range(len(t))]) for mix, t in by_mix.items() for i, r in enumerate(t.itertuples())
    ]
    schema = "mix_name string, doc_id bigint, source string, copies bigint, tokens bigint"
    report = "mix_name string, source string, target_share double, reached_share double, labelled_share double, planned_share double, tokens bigint, available_tokens bigint, documents bigint, max_repeats int, steps int, off double"
    if not lines:
        return spark.createDataFrame([], schema), spark.createDataFrame([], report)
    # At most 10,000 rows, so it can be sent to every task.
    wanted = F.broadcast(spark.createDataFrame(lines, "mix_name string, source string, k int, cap double, m array<double>"))
    members = sized.join(wanted, "source").select("mix_name", "doc_id", "source", "tokens", "cap", "m")
    if model.sources:
        mixes = F.array(*[
            F.struct(
                F.lit(mix).alias("mix_name"), F.array(*[F.lit(model.sources.index(x) if x in model.sources else -1) for x in t["source"]]).alias("at"),
                F.array(*[F.lit(float(x)) for x in t["max_repeats"]]).alias("caps"),
            ) for mix, t in by_mix.items()
        ])
        each = nameless.select("doc_id", "tokens", "posterior", F.explode(mixes).alias("x"))
        part = F.transform("x.at", lambda i: F.coalesce(F.get("posterior", i), F.lit(0.0)))
        each = each.select(F.col("x.mix_name").alias("mix_name"), "doc_id", "tokens", F.col("x.caps").alias("caps"), part.alias("m")).where(F.array_max("m") > 0)
        likeliest = F.element_at("caps", F.array_position("m", F.array_max("m")).cast("int"))
        members = members.unionByName(each.select("mix_name", "doc_id", F.lit(None).cast("string").alias("source"), "tokens", likeliest.alias("cap"), "m"))
    members = cut(members)
    cells = members.groupBy("mix_name", "m", "cap").agg(F.sum("tokens").cast("double").alias("tokens"))
    state = fit_rates(cells, by_mix, s)
    fitted = {mix: (x["start"], x["history"]) for mix, x in state.items()}

    # One row per mix and source.
    counts = F.broadcast(members.groupBy("mix_name", F.coalesce("source", F.lit(NO_SOURCE)).alias("s")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / s.block)).alias("blocks")))
    placed = members.withColumn("order", F.xxhash64("doc_id", F.lit(s.seed))).withColumn("s", F.coalesce("source", F.lit(NO_SOURCE)))
    placed = placed.join(counts, ["mix_name", "s"]).withColumn("block", F.pmod("order", F.col("blocks"))).drop("blocks")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable")
        start, history = fitted[pdf["mix_name"].iloc[0]]
        rates = _steps(np.stack(pdf["m"].to_numpy()), pdf["cap"].to_numpy(), history, start)
        pdf["copies"] = np.minimum(whole_copies(rates, pdf["tokens"].to_numpy(dtype="float64")), pdf["cap"].to_numpy()).astype("int64")
        return pdf.loc[pdf["copies"] > 0, ["mix_name", "doc_id", "source", "copies", "tokens", "m"]]

    grouped = placed.groupBy("mix_name", "s", "block")
    chosen = cut(grouped.applyInPandas(choose, f"{schema}, m array<double>"))
    size = F.col("copies") * F.col("tokens")
    parts_of = chosen.select("mix_name", size.alias("size"), F.posexplode("m").alias("k", "p"))
    held = {(r.mix_name, r.k): r.t for r in parts_of.groupBy("mix_name", "k").agg(F.sum(F.col("p") * F.col("size")).alias("t")).collect()}

    got = {
        (r.mix_name, r.source): (r.t, r.n)
        for r in chosen.groupBy("mix_name", "source").agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    }
    lines = []
    for mix, t in by_mix.items():
        total = sum(v[0] for (m, _), v in got.items() if m == mix) or 1
        expected = state[mix].get("expected", np.zeros(len(t)))
        for i, r in enumerate(t.itertuples()):
            tokens, n = got.get((mix, r.source), (0, 0))
            reached, planned = float(held.get((mix, i), 0.0) / total), float(expected[i] / max(expected.sum(), 1.0))
            lines.append((mix, r.source, float(r.target_share), reached, tokens / total, planned, int(tokens), int(r.hard_tokens), int(n), int(r.max_repeats), len(state[mix]["history"]), state[mix]["off"]))
        if (mix, None) in got:
            tokens, n = got[(mix, None)]
            lines.append((mix, None, 0.0, 0.0, tokens / total, 0.0, int(tokens), 0, int(n), 0, len(state[mix]["history"]), state[mix]["off"]))
    return chosen.drop("m"), spark.createDataFrame(lines, report)
