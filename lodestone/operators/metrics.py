"""Evaluation of scores: ranks, curves, operating points, reference distributions, intervals."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.udf import on_series

FIXED_THRESHOLDS = [float("-inf"), 0.0, 0.2, 0.3, 0.4, 0.5, 1.0, float("inf")]


def running(counts: DataFrame, by: str, columns: list[str], buckets: int = 64) -> DataFrame:
    """Adds below_<c>: the sum of c over rows of smaller `by`, of which each value occurs once.

    Values are cut into ranges; sums run within each range, and totals of the ranges before it, a row a range, are added: no
    task sees all values."""
    bounds = counts.approxQuantile(by, [k / buckets for k in range(1, buckets)], 0.001) if buckets > 1 else []
    edges = F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    rows = counts.withColumn("_b", F.size(F.filter(edges, lambda e: e < F.col(by))))
    inside = Window.partitionBy("_b").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_b").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    totals = totals.select("_b", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns))
    for c in columns:
        rows = rows.withColumn(f"below_{c}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(totals), "_b")
    return rows.select(*counts.columns, *((F.col(f"below_{c}") + F.col(f"_o_{c}")).cast("long").alias(f"below_{c}") for c in columns))


def by_score(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """score, p, n: positives and negatives of each distinct score."""
    return rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: auc (ties count half), positives, negatives. auc is null unless all scores are finite and both kinds occur."""
    counted = running(by_score(rows, score, positive), "score", ["n"])
    bad = F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
    wins = F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2))
    value = F.when(bad == 0, F.try_divide(wins, F.sum("p") * F.sum("n")))
    return counted.agg(F.round(value, 6).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def curve(rows: DataFrame, score: str, positive: Column, fixed: list[float] = FIXED_THRESHOLDS) -> DataFrame:
    """threshold, tp, fp, tpr, fpr, accuracy at every distinct score and the fixed thresholds; score >= threshold counts."""
    counted = running(by_score(rows, score, positive), "score", ["p", "n"])
    totals = rows.agg(F.count_if(positive).alias("all_p"), F.count_if(~positive).alias("all_n"))
    at_scores = counted.crossJoin(F.broadcast(totals)).select(F.col("score").alias("threshold"), (F.col("all_p") - F.col("below_p")).alias("tp"), (F.col("all_n") - F.col("below_n")).alias("fp"), "all_p", "all_n")
    thresholds = F.explode(F.array(*map(F.lit, fixed))).alias("threshold")
    tried = rows.select(thresholds, F.col(score).cast("double").alias("s"), positive.alias("y")).groupBy("threshold").agg(F.count_if((F.col("s") >= F.col("threshold")) & F.col("y")).alias("tp"), F.count_if((F.col("s") >= F.col("threshold")) & ~F.col("y")).alias("fp"))
    both = at_scores.unionByName(tried.crossJoin(F.broadcast(totals)).select("threshold", "tp", "fp", "all_p", "all_n")).dropDuplicates(["threshold"])
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select("threshold", "tp", "fp", F.round(safe(F.col("tp"), F.col("all_p")), 6).alias("tpr"), F.round(safe(F.col("fp"), F.col("all_n")), 6).alias("fpr"), F.round(safe(F.col("tp") + F.col("all_n") - F.col("fp"), F.col("all_p") + F.col("all_n")), 6).alias("accuracy"))


def operating_point(points: DataFrame, target: float) -> DataFrame:
    """One row: the highest tpr with fpr <= target, of equals the lowest fpr, then the highest threshold."""
    best = points.where(F.col("fpr") <= target).agg(F.max(F.struct("tpr", (-F.col("fpr")).alias("f"), "threshold", "fp")).alias("x"))
    return best.select(F.lit(target).alias("target_fpr"), F.col("x.tpr").alias("tpr"), (-F.col("x.f")).alias("fpr"), F.col("x.threshold").alias("threshold"), F.col("x.fp").alias("fp"))


def against_reference(rows: DataFrame, reference: DataFrame, score: str) -> DataFrame:
    """Adds below, equal: reference scores under and at each row's, and n_reference. Distinct values of both are counted and
    summed in ranges, no pair of rows is compared."""
    ref = reference.groupBy(F.col(score).cast("double").alias("v")).agg(F.count("*").alias("r"))
    own = rows.select(F.col(score).cast("double").alias("v")).distinct().withColumn("r", F.lit(0).cast("long"))
    counted = running(ref.unionByName(own).groupBy("v").agg(F.sum("r").alias("r")), "v", ["r"])
    total = reference.agg(F.count("*").alias("n_reference"))
    return rows.withColumn("v", F.col(score).cast("double")).join(counted, "v").drop("v").withColumnsRenamed({"r": "equal", "below_r": "below"}).crossJoin(F.broadcast(total))


def conformal_p(rows: DataFrame) -> Column:
    """(1 + reference scores at or over the row's) / (n + 1)."""
    return (1 + F.col("n_reference") - F.col("below")) / (F.col("n_reference") + 1)


def midrank_percentile() -> Column:
    return F.coalesce(F.try_divide(F.col("below") + 0.5 * F.col("equal"), F.col("n_reference")), F.lit(0.5))


def zscore(value: Column, mean: Column, sigma: Column) -> Column:
    return F.when(sigma > 0, (value - mean) / sigma).otherwise(0.0)


@on_series("double")
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))), na_action="ignore")


def wilson_lower(successes: Column, total: Column, z: float = 1.96) -> Column:
    p = F.try_divide(successes, total)
    return F.coalesce(F.try_divide(p + z * z / (2 * total) - z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total), 1 + z * z / total), F.lit(0.0))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: agreement, kappa (null where chance agreement is whole), n."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    n = F.sum("c").over(Window.partitionBy())  # cells: as many as pairs of labels
    left, right = F.sum("c").over(Window.partitionBy("a")), F.sum("c").over(Window.partitionBy("b"))
    cells = cells.withColumn("n", n).withColumn("x", left).withColumn("y", right)
    seen = F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)) / F.max("n")
    # each label's chance agreement is on the diagonal, whether or not that cell occurs
    marg = cells.select("a", "x", "n").distinct().join(cells.select(F.col("b").alias("a"), "y").distinct(), "a").agg(F.sum(F.col("x") * F.col("y") / (F.col("n") * F.col("n"))).alias("e"))
    both = cells.agg(seen.alias("o"), F.max("n").alias("n")).crossJoin(F.broadcast(marg))
    e = F.coalesce("e", F.lit(0.0))
    return both.select(F.round("o", 6).alias("agreement"), F.round(F.when(e < 1, (F.col("o") - e) / (1 - e)), 6).alias("kappa"), "n")


def clopper_pearson(successes: int, trials: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact binomial interval, by bisection on the tail of the distribution."""
    alpha = (1 - confidence) / 2

    def tail(k: int, p: float) -> float:
        """P(X <= k)"""
        if p <= 0:
            return 1.0
        if p >= 1:
            return 1.0 if k >= trials else 0.0
        logs = [math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) + i * math.log(p) + (trials - i) * math.log1p(-p) for i in range(k + 1)]
        return min(1.0, math.fsum(map(math.exp, logs)))

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if f(middle) else (low, middle)
        return (low + high) / 2

    lower = 0.0 if successes == 0 else solve(lambda p: 1 - tail(successes - 1, p) < alpha)
    upper = 1.0 if successes == trials else solve(lambda p: tail(successes, p) > alpha)
    return lower, upper


def hypergeometric_survival(population: int, eligible: int, sample: int, at_least: int) -> float:
    """P(X >= at_least) of eligible members in a sample without replacement."""
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    low, high = max(at_least, 0, sample - (population - eligible)), min(sample, eligible)
    return min(1.0, math.fsum(math.exp(choose(eligible, k) + choose(population - eligible, sample - k) - choose(population, sample)) for k in range(low, high + 1)))


def eligible_lower_bound(population: int, sample: int, observed: int, alpha: float = 0.05) -> int:
    """The least number of eligible members under which at least so many in the sample aren't rarer than alpha."""
    low, high = observed, population
    while low < high:
        middle = (low + high) // 2
        if hypergeometric_survival(population, middle, sample, observed) > alpha:
            high = middle
        else:
            low = middle + 1
    return low


def bootstrap_auc(rows: DataFrame, score: str, positive: Column, draws: int = 2000, seed: int = 42, most: int = 200_000) -> DataFrame:
    """One row: lower and upper 2.5 % percentiles of the AUC over stratified resamples.

    Resampling works on counts of distinct scores, which must be at most `most`: multinomial draws of counts are draws of
    rows with replacement. Draws are dealt over tasks, each with a generator of its own."""
    counts = by_score(rows, score, positive).orderBy("score").limit(most + 1).toPandas()
    if len(counts) > most:
        raise ValueError("bin the scores first")
    p, n = counts["p"].to_numpy(), counts["n"].to_numpy()
    if not p.sum() or not n.sum():
        raise ValueError("both kinds must occur")

    def draw(batches):
        for ids in batches:
            out = []
            for k in ids["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(k)]))
                a, b = rng.multinomial(p.sum(), p / p.sum()), rng.multinomial(n.sum(), n / n.sum())
                out.append(float((a * (np.cumsum(b) - b / 2)).sum() / (p.sum() * n.sum())))
            yield pd.DataFrame({"auc": out})

    tries = rows.sparkSession.range(0, draws, 1, 8).mapInPandas(draw, "auc double")
    return tries.agg(F.round(F.percentile("auc", F.lit(0.025)), 6).alias("lower"), F.round(F.percentile("auc", F.lit(0.975)), 6).alias("upper"), F.count("*").alias("draws"))


def bootstrap_conformal(rows: DataFrame, score: str, reserve: Column, positive: Column, alpha: float = 0.05, draws: int = 2000, seed: int = 42, most: int = 200_000) -> DataFrame:
    """One row: shares of positives and negatives accepted at level alpha against the reserve, and 2.5 % and 97.5 % percentiles
    of both. The reserve is drawn anew as well, so that the threshold's own error counts. Works on counts as bootstrap_auc."""
    group = F.when(reserve, 0).when(positive, 1).otherwise(2).alias("g")
    counts = rows.groupBy(F.col(score).cast("double").alias("s"), group).agg(F.count("*").alias("c")).orderBy("s", "g").limit(most + 1).toPandas()
    if len(counts) > most:
        raise ValueError("bin the scores first")
    table = counts.pivot_table(index="s", columns="g", values="c", fill_value=0).reindex(columns=range(3), fill_value=0).to_numpy().astype(np.int64).T
    if not table.sum(axis=1).all():
        raise ValueError("all three groups must occur")

    def rates(r, p, n):
        accepted = 1 + np.cumsum(r[::-1])[::-1] <= alpha * (1 + r.sum())
        return float((p * accepted).sum() / p.sum()), float((n * accepted).sum() / n.sum())

    def draw(batches):
        for ids in batches:
            out = []
            for k in ids["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(k)]))
                out.append(rates(*(rng.multinomial(c.sum(), c / c.sum()) for c in table)))
            yield pd.DataFrame(out, columns=["tpr", "fpr"])

    tpr, fpr = rates(*table)
    ends = [F.round(F.percentile(n, F.lit(q)), 6).alias(f"{n}_{end}") for n in ("tpr", "fpr") for end, q in (("lower", 0.025), ("upper", 0.975))]
    return rows.sparkSession.range(0, draws, 1, 8).mapInPandas(draw, "tpr double, fpr double").agg(F.lit(round(tpr, 6)).alias("tpr"), F.lit(round(fpr, 6)).alias("fpr"), *ends)


def _weighted_auc(score: np.ndarray, p: np.ndarray, n: np.ndarray) -> float:
    """Of positives p and negatives n at each score; ties count half."""
    order = np.argsort(score, kind="stable")
    _, first = np.unique(score[order], return_index=True)
    a, b = np.add.reduceat(p[order], first), np.add.reduceat(n[order], first)
    return float((a * (np.cumsum(b) - b / 2)).sum() / (p.sum() * n.sum()))


def bootstrap_auc_delta(rows: DataFrame, left: str, right: str, positive: Column, within: str | None = None, draws: int = 2000, seed: int = 42, most: int = 200_000) -> DataFrame:
    """One row: delta (AUC of left less AUC of right, the mean over the values of `within` if it is given) and its 2.5 % and
    97.5 % percentiles. Both scores of a row are drawn together; draws are stratified by label and by `within`."""
    part = F.col(within).cast("string") if within else F.lit("")
    counts = rows.groupBy(part.alias("part"), F.col(left).cast("double").alias("l"), F.col(right).cast("double").alias("r"), positive.alias("y")).agg(F.count("*").alias("c")).orderBy("part", "l", "r", "y").limit(most + 1).toPandas()
    if len(counts) > most:
        raise ValueError("bin the scores first")
    parts = [g for _, g in counts.groupby("part")]
    if any(g["y"].nunique() < 2 for g in parts):
        raise ValueError("both kinds must occur")
    tables = [(g["l"].to_numpy(), g["r"].to_numpy(), (g["c"] * g["y"]).to_numpy(), (g["c"] * ~g["y"].astype(bool)).to_numpy()) for g in parts]

    def delta(drawn) -> float:
        return float(np.mean([_weighted_auc(l, p, n) - _weighted_auc(r, p, n) for l, r, p, n in drawn]))

    def draw(batches):
        for ids in batches:
            out = []
            for k in ids["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(k)]))
                out.append(delta([(l, r, rng.multinomial(p.sum(), p / p.sum()), rng.multinomial(n.sum(), n / n.sum())) for l, r, p, n in tables]))
            yield pd.DataFrame({"d": out})

    tries = rows.sparkSession.range(0, draws, 1, 8).mapInPandas(draw, "d double")
    return tries.agg(F.round(F.lit(delta(tables)), 6).alias("delta"), F.round(F.percentile("d", F.lit(0.025)), 6).alias("lower"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("upper"))


def index_tensor(repetitions: int, cells: int, sources: int, seed: int = 42) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, sources, size=(repetitions, cells, sources))
