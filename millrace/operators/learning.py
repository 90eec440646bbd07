"""Feature pipelines, splits, training and evaluation on pyspark.ml."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, HashingTF, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import lookup, ratio
from millrace.functions.text import words
from millrace.operators import stats
from millrace.runtime import cut


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the same share of every label, decided by a hash of the key.

    The cut is the share-quantile of the hashes within a label, so no rows are ranked or moved; a key
    always falls on the same side of its label's cut.
    """
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31))
    rows = df.withColumn("_h", h)
    cuts = rows.groupBy(label).agg(F.percentile_approx("_h", F.lit(share), F.lit(10000)).alias("_cut"))
    marked = rows.join(cuts.withColumnRenamed(label, "_l"), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    return marked.where("_h <= _cut").drop("_h", "_cut"), marked.where("_h > _cut").drop("_h", "_cut")


def temporal_split(df: DataFrame, day: str, days: int = 28) -> tuple[DataFrame, DataFrame]:
    """Rows up to the last day less ``days``, and those after."""
    cut = F.date_sub(df.agg(F.max(day)).scalar(), days)
    return df.where(F.col(day) <= cut), df.where(F.col(day) > cut)


class Features:
    """Median-imputed and standardised numbers, mode-imputed ordinals, one-hot nominals, in one vector.

    Statistics are exact aggregates of the rows given to ``fit``; unknown ordinals become -1 and unknown
    nominals an own column, so unseen data never fails.
    """

    def __init__(self, numeric: Sequence[str] = (), ordinal: Mapping[str, Sequence[str]] | None = None, nominal: Sequence[str] = (), missing: str = "missing"):
        self.numeric, self.ordinal, self.nominal, self.missing = list(numeric), dict(ordinal or {}), list(nominal), missing
        self.medians: dict = {}
        self.modes: dict = {}
        self.model: PipelineModel | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        """The imputed columns; the same code serves one row and a table."""
        out = {f"{c}_n": F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians.get(c) or 0.0))) for c in self.numeric}
        for c, order in self.ordinal.items():
            out[f"{c}_o"] = lookup(F.coalesce(F.col(c), F.lit(self.modes.get(c))), {v: float(i) for i, v in enumerate(order)}, -1.0)
        out |= {f"{c}_c": F.coalesce(F.col(c).cast("string"), F.lit(self.missing)) for c in self.nominal}
        return df.withColumns(out)

    def fit(self, df: DataFrame) -> "Features":
        for c in self.numeric:
            middle = stats.percentiles(df, [], c, [0.5]).first()
            self.medians[c] = middle[0][0] if middle else None
        aggs = [F.mode(c, True).alias(f"o_{c}") for c in self.ordinal]
        if aggs:
            row = df.agg(*aggs).first()
            self.modes = {c: row[f"o_{c}"] for c in self.ordinal}
        stages, parts = [], []
        if self.numeric:
            stages += [VectorAssembler(inputCols=[f"{c}_n" for c in self.numeric], outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
            parts.append("_scaled")
        parts += [f"{c}_o" for c in self.ordinal]
        for c in self.nominal:
            stages += [
                StringIndexer(inputCol=f"{c}_c", outputCol=f"{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc"),
                OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v", dropLast=False),
            ]
            parts.append(f"{c}_v")
        stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
        self.model = Pipeline(stages=stages).fit(self.prepare(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prepare(df))


def tf_idf(df: DataFrame, key: str, text: str, most: int = 5000, min_df: int = 2, grams: int = 2) -> DataFrame:
    """Sublinear tf-idf of words and word pairs, L2-normalised: ``key, term, weight``.

    Terms occur in at least ``min_df`` documents; the ``most`` frequent are kept (ties alphabetically).
    tf = 1 + ln(count), idf = 1 + ln((1 + documents) / (1 + df)).
    """
    w = df.select(F.col(key).alias("key"), words(F.col(text)).alias("w"))

    def joined(n: int):
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        # One parameter only: transform passes the index to a second one.
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))).otherwise(F.array().cast("array<string>"))

    lists = [F.col("w")] + [joined(n) for n in range(2, grams + 1)]
    counts = w.select("key", F.explode(F.concat(*lists)).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    docs = df.agg(F.count(F.lit(1))).scalar()
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).where(F.col("df") >= min_df).orderBy(F.desc("n"), "term").limit(most)
    weighted = counts.join(vocabulary.select("term", "df"), "term").withColumn("x", (1 + F.ln("tf")) * (1 + F.ln((1 + docs) / (1 + F.col("df")))))
    length = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return weighted.join(length, "key").select(F.col("key").alias(key), "term", (F.col("x") / F.col("l")).alias("weight"))


def hashed_words(df: DataFrame, words_column: str, size: int = 4096) -> DataFrame:
    """Add ``features``: a sparse vector of hashed word counts."""
    return HashingTF(inputCol=words_column, outputCol="features", numFeatures=size).transform(df)


def label_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the position of the value in the alphabetical order of all values."""
    codes = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column, "left")


CANDIDATES = {
    "logistic": lambda: LogisticRegression(maxIter=50),
    "forest": lambda: RandomForestClassifier(numTrees=30, maxDepth=6, seed=42),
    "boosting": lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=42),
}


def probability(model, df: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1])


def compare_models(train: DataFrame, test: DataFrame, label: str, names: Sequence[str] = tuple(CANDIDATES), cost_fn: float = 1.0, cost_fp: float = 1.0):
    """Fit each candidate (classes weighted to balance) and tune its threshold: the models and a table
    ``model, auc, threshold, cost, precision, recall, f1``; the first row is the cheapest."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = lookup(F.col(label).cast("int"), {int(k): total / (len(counts) * v) for k, v in counts.items()}, 1.0)
    fitted, lines = {}, []
    for name in names:
        est = CANDIDATES[name]().setFeaturesCol("features").setLabelCol(label).setWeightCol("_w")
        fitted[name] = est.fit(train.withColumn("_w", weight))
        scored = probability(fitted[name], test).select("score", (F.col(label) == 1).alias("y"))
        best = stats.best_threshold(stats.threshold_costs(scored, "score", F.col("y"), cost_fn, cost_fp)).first()
        area = stats.auc(scored, "score", F.col("y")).first()
        c = stats.confusion(scored, F.col("y"), F.col("score") >= best.threshold).first()
        lines.append((name, area.auc if area else None, best.threshold, best.cost, c.precision, c.recall, c.f1))
    lines.sort(key=lambda x: (x[3], x[0]))
    table = train.sparkSession.createDataFrame(lines, "model string, auc double, threshold double, cost double, precision double, recall double, f1 double")
    return fitted, table


def search_logistic(df: DataFrame, label: str, grid: Sequence[float] = (0.001, 0.01, 0.1), folds: int = 3, seed: int = 42):
    """Multinomial logistic regression with the penalty of the best macro F1 in cross-validation (the smaller of equals)."""
    rows = cut(df.withColumn("_fold", F.pmod(F.xxhash64(F.col("features").cast("string"), F.lit(seed)), F.lit(folds))))
    told = {}
    for penalty in sorted(grid):
        est = LogisticRegression(featuresCol="features", labelCol=label, maxIter=40, regParam=penalty)
        scores = []
        for fold in range(folds):
            scored = est.fit(rows.where(F.col("_fold") != fold)).transform(rows.where(F.col("_fold") == fold))
            scores.append(macro_f1(class_report(scored, label, "prediction")).first().macro_f1 or 0.0)
        told[penalty] = sum(scores) / folds
    best = max(told, key=lambda x: (told[x], -x))
    return LogisticRegression(featuresCol="features", labelCol=label, maxIter=40, regParam=best).fit(df)


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``class, support, precision, recall, f1`` per class from one aggregation of pairs."""
    pairs = df.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("l").alias("class"), F.lit("l").alias("s")), F.struct(F.col("p").alias("class"), F.lit("p").alias("s")))).alias("x"), "l", "p", "n")
    hit = F.col("l") == F.col("p")
    out = sides.groupBy("x.class").agg(
        F.sum(F.when(F.col("x.s") == "l", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.s") == "p", F.col("n")).otherwise(0)).alias("claimed"),
        F.sum(F.when(hit & (F.col("x.s") == "l"), F.col("n")).otherwise(0)).alias("hits"),
    )
    return out.select(
        "class", "support", ratio(F.col("hits"), F.col("claimed")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"),
        F.coalesce(ratio(2 * F.col("hits"), F.col("support") + F.col("claimed")), F.lit(0.0)).alias("f1"),
    )


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"))


def principal_components(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Add ``components``: the first k principal components of an array column."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows)
    return model.transform(rows).withColumn("components", vector_to_array("_pc")).drop("_v", "_pc")


def importances(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Feature importances of a random forest: ``feature, importance`` in falling order."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip").transform(df.where(F.col(target).isNotNull()))
    model = RandomForestRegressor(featuresCol="_f", labelCol=target, numTrees=30, maxDepth=6, seed=42).fit(rows)
    pairs = [(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def seasonal_regression(df: DataFrame, key: str, day: str, value: str, until: str, horizon: int = 28) -> DataFrame:
    """Forecast by trend, weekday and yearly waves, one regression over all series with their own levels: ``key, day, forecast``.

    Stands in for an additive forecasting library that is not available; ``value`` is modelled in logs,
    relative to the mean of its series, so effects are multiplicative.
    """
    past = df.where((F.col(day) <= F.lit(until).cast("date")) & (F.col(value) > 0))
    level = past.groupBy(key).agg(F.avg(F.ln(value)).alias("_level"))

    def features(rows: DataFrame) -> DataFrame:
        t = F.datediff(F.col(day), F.lit(until).cast("date")) / F.lit(365.25)
        cols = {"_t": t}
        cols |= {f"_w{i}": (F.weekday(day) == i).cast("double") for i in range(6)}
        for k in (1, 2, 3):
            cols |= {f"_s{k}": F.sin(2 * 3.141592653589793 * k * t), f"_c{k}": F.cos(2 * 3.141592653589793 * k * t)}
        return VectorAssembler(inputCols=list(cols), outputCol="_f").transform(rows.withColumns(cols))

    train = features(past.join(level, key).withColumn("_y", F.ln(value) - F.col("_level")))
    model = LinearRegression(featuresCol="_f", labelCol="_y", regParam=0.001).fit(train)
    days = F.sequence(F.date_add(F.lit(until).cast("date"), 1), F.date_add(F.lit(until).cast("date"), horizon))
    future = features(level.withColumn(day, F.explode(days)))
    return model.transform(future).select(key, day, F.exp(F.col("prediction") + F.col("_level")).alias("forecast"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def synthetic_minority(df: DataFrame, key: str, features: Sequence[str], label: str, minority, copies: int = 1, buckets: int = 64, seed: int = 42) -> DataFrame:
    """All rows and ``copies`` made-up rows for each of the minority class: ``key, features, label``; the key of a made-up row is NULL.

    A made-up row lies at random between a row and its neighbour along a random direction. Neighbours are
    sought within ranges of that direction, so no task holds the whole class. Rows with a NULL feature are copied as they are.
    """
    rng = random.Random(seed)
    along = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * rng.uniform(-1, 1) for c in features), F.lit(0.0))
    few = df.where(F.col(label) == minority).select(key, label, *features).withColumn("_p", along)
    span = few.agg(F.min("_p").alias("a"), F.max("_p").alias("b"))
    a, b = span.select("a").scalar(), span.select("b").scalar()
    few = few.withColumn("_range", F.floor(F.coalesce(F.try_divide(F.col("_p") - a, b - a), F.lit(0.0)) * buckets))
    w = Window.partitionBy("_range").orderBy("_p", key)
    near = few.withColumns({f"_n_{c}": F.coalesce(F.lead(c).over(w), F.lag(c).over(w), F.col(c)) for c in features})
    near = near.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    share = F.pmod(F.xxhash64(key, "_copy", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    made = near.select(
        F.lit(None).cast(dict(df.dtypes)[key]).alias(key), *[(F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * share).alias(c) for c in features], label
    )
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in features], label).unionByName(made)


def contributions(df: DataFrame, coefficients: Sequence[float], names: Sequence[str], features: str = "features", most: int = 5) -> DataFrame:
    """Add ``contributions``: the ``most`` features that move a linear score most, as ``feature, value, effect``."""
    c, n = F.array(*[F.lit(float(x)) for x in coefficients]), F.array(*[F.lit(x) for x in names])
    parts = F.transform(vector_to_array(features), lambda x, i: F.struct(F.abs(x * c[i]).alias("_size"), F.get(n, i).alias("feature"), x.alias("value"), (x * c[i]).alias("effect")))
    top = F.slice(F.reverse(F.array_sort(parts)), 1, most)
    return df.withColumn("contributions", F.transform(top, lambda p: F.struct(p["feature"].alias("feature"), p["value"].alias("value"), p["effect"].alias("effect"))))


def with_own_values(df: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` important features (``feature, importance``) of every row with the row's own value: adds ``feature, importance, value``."""
    top = found.orderBy(F.desc("importance"), "feature").limit(most).collect()
    pairs = F.array(*[F.struct(F.lit(r.feature).alias("feature"), F.lit(r.importance).alias("importance"), F.col(r.feature).cast("double").alias("value")) for r in top])
    return df.withColumn("_x", F.explode(pairs)).select(*df.columns, "_x.*")


def series_forecast(
    df: DataFrame, key: str, day: str, value: str, until: str, horizon: int = 28, regressors: Sequence[str] = (), holiday: str | None = None, width: float = 1.96
) -> DataFrame:
    """One fit per series, forecast with a band: ``key, day, forecast, low, high``.

    Logs of the values are explained by trend, weekday, yearly waves, ``regressors`` and a ``holiday`` flag by least squares;
    future rows take the regressors from ``df`` (days after ``until``; values there are not used) and the mean where they are NULL.
    A series has a row a day, so it fits a task. Series with fewer than 14 positive values have no forecast.
    """
    extra = [*regressors, *([holiday] if holiday else [])]
    kind = dict(df.dtypes)[key]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        t = (pd.to_datetime(pdf["day"]) - pd.Timestamp(until)).dt.days.to_numpy(dtype="float64")
        past = (t <= 0) & (pdf["value"].to_numpy(dtype="float64") > 0)
        if past.sum() < 14 or not (t > 0).any():
            return pdf.iloc[:0][["key", "day"]].assign(forecast=0.0, low=0.0, high=0.0)
        x = pdf[extra].astype("float64")
        x = x.fillna(x[past].mean()).fillna(0.0).to_numpy()
        weekday = pd.to_datetime(pdf["day"]).dt.weekday.to_numpy()
        waves = [f(2 * np.pi * k * t / 365.25) for k in (1, 2) for f in (np.sin, np.cos)]
        design = np.column_stack([np.ones_like(t), t / 365.25, *[(weekday == i).astype(float) for i in range(6)], *waves, x])
        y = np.log(pdf["value"].to_numpy(dtype="float64")[past])
        ridge = np.sqrt(1e-3) * np.eye(design.shape[1])
        beta = np.linalg.lstsq(np.vstack([design[past], ridge]), np.concatenate([y, np.zeros(len(ridge))]), rcond=None)[0]
        spread = float(np.std(y - design[past] @ beta, ddof=1))
        ahead = (t > 0) & (t <= horizon)
        mean = design[ahead] @ beta
        return pd.DataFrame({
            "key": pdf["key"].to_numpy()[ahead], "day": pdf["day"].to_numpy()[ahead], "forecast": np.exp(mean),
            "low": np.exp(mean - width * spread), "high": np.exp(mean + width * spread),
        })

    rows = df.select(F.col(key).alias("key"), F.col(day).cast("date").alias("day"), F.col(value).cast("double").alias("value"), *[F.col(c).cast("double").alias(c) for c in extra])
    rows = rows.where("key IS NOT NULL AND day IS NOT NULL")
    found = rows.groupBy("key").applyInPandas(fit, f"key {kind}, day date, forecast double, low double, high double")
    return found.withColumnsRenamed({"key": key, "day": day})


def text_vectors(df: DataFrame, text: str, name: str = "vector", size: int = 64) -> DataFrame:
    """Add ``name``: a unit vector of each text, its word counts (damped by 1 + ln) projected along random signs per word.

    Texts that share words have similar vectors. Signs come from a hash of the word, so no model is fitted or sent. Texts
    without words have NULL.
    """
    from hashlib import blake2b

    @F.arrow_udf("array<double>")
    def project(texts: pa.Array) -> pa.Array:
        coded = texts.flatten().dictionary_encode()
        names = np.array(coded.dictionary.to_pylist(), dtype=object)
        order = np.argsort(names)
        at = np.empty(len(order), "int64")
        at[order] = np.arange(len(order))
        wide = -(-size // 8)
        bits = b"".join(blake2b(w.encode(), digest_size=wide).digest() for w in names[order])
        signs = np.unpackbits(np.frombuffer(bits, "uint8").reshape(len(names), wide), axis=1)[:, :size].astype("float64") * 2 - 1
        row = np.repeat(np.arange(len(texts)), texts.value_lengths().fill_null(0).to_numpy())
        each, counts = np.unique(row * len(names) + at[coded.indices.to_numpy()], return_counts=True)
        row, word = (each // len(names), each % len(names)) if len(names) else (each, each)
        out = np.zeros((len(texts), size))
        borders = np.searchsorted(row, np.arange(len(texts) + 1))
        for i, (lo, hi) in enumerate(zip(borders, borders[1:])):
            if lo < hi:
                out[i] = (1 + np.log(counts[lo:hi])) @ signs[word[lo:hi]]
        length = np.linalg.norm(out, axis=1)
        unit = out / np.where(length > 0, length, 1.0)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), unit.reshape(-1), mask=pa.array(length == 0))

    return df.withColumn(name, project(words(F.col(text))))
