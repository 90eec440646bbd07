"""Statistics: experiments, score evaluation, drift and difference in differences.

Everything that depends on the number of rows is an aggregate; only finished aggregates reach Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import ratio
from millrace.operators.scan import running_total

NORMAL = NormalDist()


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to about 1e-7, as a JVM expression (Abramowitz and Stegun 26.2.17)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def sample_size(baseline: float, lift: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Rows per arm to see a change from ``baseline`` by ``lift`` (arcsine effect size, two-sided)."""
    h = 2 * math.asin(math.sqrt(baseline + lift)) - 2 * math.asin(math.sqrt(baseline))
    z = NORMAL.inv_cdf(1 - alpha / 2) + NORMAL.inv_cdf(power)
    return math.ceil(2 * (z / h) ** 2)


def two_proportions(n_a: int, x_a: int, n_b: int, x_b: int, alpha: float = 0.05) -> dict:
    """Pooled one-sided z test that B is larger, with an unpooled two-sided interval of the lift."""
    if not n_a or not n_b:
        return {"z": None, "p_value": None, "lift": None, "low": None, "high": None, "significant": False}
    p_a, p_b, p = x_a / n_a, x_b / n_b, (x_a + x_b) / (n_a + n_b)
    se = math.sqrt(p * (1 - p) * (1 / n_a + 1 / n_b))
    z = (p_b - p_a) / se if se else 0.0
    wide = NORMAL.inv_cdf(1 - alpha / 2) * math.sqrt(p_a * (1 - p_a) / n_a + p_b * (1 - p_b) / n_b)
    p_value = 1 - NORMAL.cdf(z)
    return {
        "z": z, "p_value": p_value, "rate_a": p_a, "rate_b": p_b, "lift": p_b - p_a, "relative": (p_b - p_a) / p_a if p_a else None,
        "low": p_b - p_a - wide, "high": p_b - p_a + wide, "significant": p_value < alpha,
    }


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the incomplete beta function."""
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def welch(n_a: int, mean_a: float, var_a: float, n_b: int, mean_b: float, var_b: float) -> dict:
    """Welch's t test from counts, means and sample variances."""
    u, v = var_a / n_a, var_b / n_b
    if u + v == 0:
        return {"t": 0.0, "df": float(n_a + n_b - 2), "p_value": 1.0}
    t = (mean_b - mean_a) / math.sqrt(u + v)
    df = (u + v) ** 2 / (u * u / (n_a - 1) + v * v / (n_b - 1))
    return {"t": t, "df": df, "p_value": t_two_sided(t, df)}


def arms(df: DataFrame, variant: str, converted: Column, value: Column) -> DataFrame:
    """Per variant: ``n, conversions, rate, mean, variance``."""
    out = df.groupBy(variant).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(converted).alias("conversions"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance")
    )
    return out.withColumn("rate", ratio(F.col("conversions"), F.col("n")))


# Scores -----------------------------------------------------------------------------------------
def confusion(df: DataFrame, label: Column, flagged: Column, by: Sequence[str] = ()) -> DataFrame:
    """``tp, fp, fn, tn, precision, recall, f1``; NULL labels and flags count as negative."""
    y, p = F.coalesce(label, F.lit(False)), F.coalesce(flagged, F.lit(False))
    cells = {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}
    out = df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    return out.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def by_score(df: DataFrame, score: str, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: everything that rank statistics need, without sorting rows."""
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(label).alias("pos"), F.count_if(~label).alias("neg")
    )


def auc(df: DataFrame, score: str, label: Column, by: Sequence[str] = (), least: int = 1, least_positive: int = 1, block: float = 0.01) -> DataFrame:
    """Area under the ROC curve per group with ties counted half: ``by, n, positives, auc``.

    Rows are folded to distinct scores; the negatives below a score come from a running total in
    blocks of the score's range, so no group is sorted in one task.
    """
    keys = list(by) or ["_all"]
    src = by_score(df, score, label, by)
    src = src if by else src.withColumn("_all", F.lit(1))
    src = src.withColumn("_block", F.floor(F.col("score") / block))
    below = running_total(src, keys, "_block", ["score"], "neg", "below")
    out = below.groupBy(*keys).agg(
        (F.sum("pos") + F.sum("neg")).alias("n"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("wins"),
    )
    out = out.where((F.col("n") >= least) & (F.col("positives") >= least_positive))
    return out.select(*by, "n", "positives", ratio(F.col("wins"), F.col("positives") * F.col("negatives")).alias("auc"))


def threshold_costs(df: DataFrame, score: str, label: Column, cost_fn: float, cost_fp: float, low: int = 10, high: int = 89) -> DataFrame:
    """Cost of flagging from each threshold (in hundredths) on: ``threshold, fn, fp, cost``.

    A row adds to the thresholds up to its score; rows are first folded to their hundredth, so the grid
    never multiplies the data. A NULL score is never flagged.
    """
    step = F.least(F.lit(high), F.coalesce(F.floor(F.round(F.col(score) * 100.0, 9)).cast("int"), F.lit(low - 1)))
    cells = df.groupBy(F.greatest(F.lit(low - 1), step).alias("at")).agg(F.count_if(label).alias("pos"), F.count_if(~label).alias("neg"))
    grid = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    spread = cells.where(f"at >= {low}").select(F.explode(F.sequence(F.lit(low), "at")).alias("t"), "pos", "neg").groupBy("t").agg(
        F.sum("pos").alias("tp"), F.sum("neg").alias("fp")
    )
    positives = cells.agg(F.sum("pos")).scalar()
    out = grid.join(spread, "t", "left").select(
        (F.col("t") / 100.0).alias("threshold"), (positives - F.coalesce("tp", F.lit(0))).alias("fn"), F.coalesce("fp", F.lit(0)).alias("fp")
    )
    return out.withColumn("cost", F.col("fn") * cost_fn + F.col("fp") * cost_fp)


def best_threshold(costs: DataFrame) -> DataFrame:
    """The threshold of least cost; the lowest of equals."""
    return costs.agg(F.min_by(F.struct("threshold", "cost"), F.struct("cost", "threshold")).alias("x")).select("x.*")


def roc_points(df: DataFrame, score: str, label: Column) -> DataFrame:
    """ROC and precision-recall points at every distinct score: ``score, tpr, fpr, precision``."""
    src = by_score(df, score, label).withColumn("_all", F.lit(1)).withColumn("_block", F.floor(-F.col("score") / 0.01))
    tp = running_total(src, ["_all"], "_block", [F.desc("score")], "pos", "tp0")
    both = running_total(tp, ["_all"], "_block", [F.desc("score")], "neg", "fp0")
    sums = src.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tp_, fp_ = F.col("tp0") + F.col("pos"), F.col("fp0") + F.col("neg")
    p, n = sums.select("p").scalar(), sums.select("n").scalar()
    return both.select("score", ratio(tp_, p).alias("tpr"), ratio(fp_, n).alias("fpr"), ratio(tp_, tp_ + fp_).alias("precision"))


def psi(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index over the baseline's quantile bins: ``psi, status``.

    Edges are distinct quantiles; bins are closed on the left, the last on both sides; values
    outside count in the totals only. Fewer than two edges give 0.
    """
    at = [i / bins for i in range(bins + 1)]
    found = percentiles(baseline, [], column, at).first()
    edges = sorted(set(found[0])) if found else []
    spark = baseline.sparkSession
    if len(edges) < 2:
        return spark.createDataFrame([(0.0, "STABLE")], "psi double, status string")
    x = F.col(column)
    bin_ = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        upper = x <= edges[i + 1] if i == len(edges) - 2 else x < edges[i + 1]
        bin_ = F.when((x >= edges[i]) & upper, F.lit(i)).otherwise(bin_)

    def shares(df, name):
        counts = df.where(x.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n")).scalar()
        return counts.where("bin IS NOT NULL").select("bin", ratio(F.col("n"), total).alias(name))

    grid = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    both = grid.join(shares(baseline, "b"), "bin", "left").join(shares(current, "c"), "bin", "left")
    b, c = F.coalesce("b", F.lit(0.0)) + eps, F.coalesce("c", F.lit(0.0)) + eps
    out = both.agg(F.sum((c - b) * F.ln(c / b)).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") < 0.1, "STABLE").when(F.col("psi") < 0.2, "MODERATE").otherwise("SIGNIFICANT"))


# Difference in differences ----------------------------------------------------------------------
def difference_in_differences(df: DataFrame, treated: Column, after: Column, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Estimate with HC3 standard error of the saturated 2 x 2 design: ``by, n, did, se, z, low, high``.

    Each cell has leverage 1/n, so the variance of its mean is the sum of squared residuals over
    (n - 1)^2; four aggregates say everything that the regression would.
    """
    cell = (
        df.where(F.col(value).isNotNull()).groupBy(*by, treated.alias("t"), after.alias("a"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
        .withColumn("vm", F.col("v") * (F.col("n") - 1) / ((F.col("n") - 1) * (F.col("n") - 1)))
    )
    sign = F.when(F.col("t") == F.col("a"), 1.0).otherwise(-1.0)
    out = cell.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(sign * F.col("m")).alias("did"), F.sqrt(F.sum("vm")).alias("se"), F.count(F.lit(1)).alias("cells"))
    return out.where("cells = 4").drop("cells").withColumns(
        {"z": ratio(F.col("did"), F.col("se")), "low": F.col("did") - 1.96 * F.col("se"), "high": F.col("did") + 1.96 * F.col("se")}
    )


def mean_difference(df: DataFrame, by: Sequence[str], treated: Column, value: str, least: int = 1) -> DataFrame:
    """Treated minus untreated mean per group (an event study if the group is the relative week): ``by, n, difference, se``."""
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(treated, F.col(value))) - F.avg(F.when(~treated, F.col(value)))).alias("difference"),
        F.sqrt(
            F.var_samp(F.when(treated, F.col(value))) / F.count_if(treated) + F.var_samp(F.when(~treated, F.col(value))) / F.count_if(~treated)
        ).alias("se"),
    )
    return out.where(F.col("n") >= least)


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``correlation, slope, intercept`` of y on x."""
    return df.groupBy(*by).agg(F.corr(x, y).alias("correlation"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def running_window(keys: Sequence[str], order: str, first: int, last: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)


def monitoring(df: DataFrame, score: str, flagged: Column, label: Column) -> DataFrame:
    """``n, mean, flagged_rate, p95, distribution``; p95 is the value at position floor(0.95 n) of the sorted scores.

    The position is found in the counts per distinct score, and the distribution is a map of label counts.
    """
    rows = df.where(F.col(score).isNotNull())
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), ratio(F.count_if(flagged), F.count(F.lit(1))).alias("flagged_rate"))
    counts = rows.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("c")).withColumn("_all", F.lit(1)).withColumn("_block", F.floor(F.col("score") / 0.01))
    before = running_total(counts, ["_all"], "_block", ["score"], "c", "before")
    at = F.floor(one.select("n").scalar() * 0.95)
    p95 = before.where((F.col("before") <= at) & (at < F.col("before") + F.col("c"))).agg(F.max("score")).scalar()
    told = rows.groupBy(label.alias("l")).agg(F.count(F.lit(1)).alias("c")).where("l IS NOT NULL")
    pairs = told.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "c"))))).scalar()
    return one.withColumn("p95", p95).withColumn("distribution", pairs)


def gaps_to_overall(groups: DataFrame, overall: DataFrame, measure: str) -> DataFrame:
    """Add ``gap``: the measure of each group less that of all rows."""
    return groups.withColumn("gap", F.col(measure) - overall.select(measure).scalar())


def drift_report(baseline: DataFrame, current: DataFrame, columns: Sequence[str], least: int = 10, least_rows: int = 50) -> DataFrame:
    """``column, psi, status, alert`` for every column with enough values; empty if there are too few rows."""
    spark = baseline.sparkSession
    sizes = current.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    out = spark.createDataFrame([], "column string, psi double, status string, alert boolean")
    if sizes["rows"] < least_rows:
        return out
    for i, c in enumerate(columns):
        if sizes[f"c{i}"] >= least:
            out = out.unionByName(psi(baseline, current, c).withColumn("column", F.lit(c)).withColumn("alert", F.col("status") == "SIGNIFICANT"))
    return out


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation per group: ``by, percentiles`` in the order of ``shares``.

    Counts per distinct value and a running total in blocks of the value's size find the positions, so
    no group's values are held in one buffer. NULL and NaN are left out; groups without values have no row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    keys = list(by) or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    block = F.signum("_v") * F.floor(F.ln(1 + F.abs("_v")) * 20)
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", block)
    before = running_total(counts, keys, "_b", ["_v"], "_c", "_before")
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    at = before.join(sizes, keys)
    holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_c"))
    aggs = []
    for k, p in enumerate(shares):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [F.max(F.when(holds(F.floor(place)), F.col("_v"))).alias(f"_l{k}"), F.max(F.when(holds(F.ceil(place)), F.col("_v"))).alias(f"_h{k}")]
    found = at.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    part = lambda p: F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1))
    values = [F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * part(p) for k, p in enumerate(shares)]
    return found.select(*by, F.array(*values).alias("percentiles"))


def average_precision(df: DataFrame, score: str, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the precision at every positive, ties sharing one precision: ``by, average_precision``."""
    keys = list(by) or ["_all"]
    src = by_score(df, score, label, by)
    src = src if by else src.withColumn("_all", F.lit(1))
    src = src.withColumn("all", F.col("pos") + F.col("neg")).withColumn("_block", F.floor(-F.col("score") / 0.01))
    tp = running_total(src, keys, "_block", [F.desc("score")], "pos", "tp0")
    both = running_total(tp, keys, "_block", [F.desc("score")], "all", "n0")
    at = ratio(F.col("tp0") + F.col("pos"), F.col("n0") + F.col("all"))
    return both.groupBy(*keys).agg(ratio(F.sum(F.col("pos") * at), F.sum("pos")).alias("average_precision")).select(*by, "average_precision")


def threshold_curve(df: DataFrame, score: str, label: Column, cost_fn: float, cost_fp: float, low: int = 5, high: int = 94) -> DataFrame:
    """``threshold_costs`` with precision, recall and F1 at every threshold."""
    costs = threshold_costs(df, score, label, cost_fn, cost_fp, low, high)
    positives = df.agg(F.count_if(label)).scalar()
    tp = positives - F.col("fn")
    return costs.withColumns(
        {"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))}
    )


def class_means(df: DataFrame, features: Sequence[str], label: Column) -> DataFrame:
    """Mean of each feature with and without a label: ``feature, with_label, without_label, difference``."""
    one = df.agg(*[F.avg(F.when(label, F.col(f))).alias(f"w{i}") for i, f in enumerate(features)], *[F.avg(F.when(~label, F.col(f))).alias(f"o{i}") for i, f in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"w{i}").alias("with_label"), F.col(f"o{i}").alias("without_label")) for i, f in enumerate(features)])
    return one.select(F.explode(pairs).alias("x")).select("x.*").withColumn("difference", F.col("with_label") - F.col("without_label"))


def proportion_test(df: DataFrame, in_a: Column, in_b: Column, converted: Column, alpha: float = 0.05) -> DataFrame:
    """One row: rates, lift, z, one-sided p-value that B is larger, and the interval of the lift."""
    g = df.agg(F.count_if(in_a).alias("na"), F.count_if(in_b).alias("nb"), F.count_if(in_a & converted).alias("xa"), F.count_if(in_b & converted).alias("xb"))
    a, b = ratio(F.col("xa"), F.col("na")), ratio(F.col("xb"), F.col("nb"))
    p = ratio(F.col("xa") + F.col("xb"), F.col("na") + F.col("nb"))
    z = F.try_divide(b - a, F.sqrt(p * (1 - p) * (1 / F.col("na") + 1 / F.col("nb"))))
    wide = NORMAL.inv_cdf(1 - alpha / 2) * F.sqrt(a * (1 - a) / F.col("na") + b * (1 - b) / F.col("nb"))
    return g.select(
        a.alias("rate_a"), b.alias("rate_b"), (b - a).alias("lift"), F.try_divide(b - a, a).alias("relative"), z.alias("z"), (1 - normal_cdf(z)).alias("p_value"),
        (b - a - wide).alias("low"), (b - a + wide).alias("high"),
    )


def welch_guardrail(df: DataFrame, in_a: Column, in_b: Column, value: str, critical: float = 1.96) -> DataFrame:
    """One row: means, Welch's t and degrees of freedom, and whether B passes (no significant change, or no worse than A)."""
    g = df.agg(*[f(F.when(c, F.col(value))).alias(f"{n}{s}") for c, s in ((in_a, "a"), (in_b, "b")) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    u, w = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    t = F.try_divide(F.col("mb") - F.col("ma"), F.sqrt(u + w))
    df_ = F.try_divide((u + w) * (u + w), u * u / (F.col("na") - 1) + w * w / (F.col("nb") - 1))
    return g.select(F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), t.alias("t"), df_.alias("df"), ((F.abs(t) < critical) | (F.col("mb") >= F.col("ma"))).alias("passes"))


def did_fit(df: DataFrame, treated: Column, after: Column, value: str) -> DataFrame:
    """Difference in differences with its two-sided p-value (normal) and the R2 of the saturated design."""
    rows = df.where(F.col(value).isNotNull())
    cells = rows.groupBy(treated.alias("t"), after.alias("a")).agg(F.count(F.lit(1)).alias("n"), F.var_samp(value).alias("v"))
    sse = cells.agg(F.sum(F.col("v") * (F.col("n") - 1))).scalar()
    sst = rows.agg(F.var_samp(value) * (F.count(F.lit(1)) - 1)).scalar()
    found = difference_in_differences(df, treated, after, value)
    return found.select("did", "se", (1 - F.try_divide(sse, sst)).alias("r2"), (2 * (1 - normal_cdf(F.abs("z")))).alias("p_value"))
