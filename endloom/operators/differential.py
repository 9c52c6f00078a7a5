"""Differential counts between two conditions: negative-binomial models with shared dispersion.

Every feature is one row with an array of its counts by sample, so features stay distributed.
Each gets its own dispersion by the adjusted profile likelihood; a trend over the mean is
fitted to one row for each step of the mean; dispersions are drawn towards the trend by an
empirical prior; and the log ratio of the conditions is tested by its Wald statistic. All
kernels work on whole batches of features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import _two_sided, benjamini_hochberg, size_factors

#: Most samples of a design; a feature's counts are one row.
MAX_SAMPLES = 10_000
#: Dispersions between which the likelihood is searched, and steps of the search.
LEAST, MOST, STEPS = 1e-8, 20.0, 60
#: Means below this count as this in the weights of the models.
MIN_MEAN = 0.5


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series after a shift of eight."""
    y = x + 8
    product = np.log(x)
    for k in range(1, 8):
        product = product + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - product


def trigamma(x: float) -> float:
    total = 0.0
    while x < 8:
        total, x = total + 1 / x**2, x + 1
    return total + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5)


def group_mean(counts: np.ndarray, factors: np.ndarray, alpha: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The mean (before size factors) of each row under dispersion alpha, by Newton steps on
    its logarithm; 0 for rows without counts."""
    q = counts.sum(axis=1) / factors.sum()
    some = q > 0
    log = np.log(np.where(some, q, 1.0))
    for _ in range(rounds):
        mu = np.exp(log)[:, None] * factors
        w = 1 / (1 + alpha[:, None] * mu)
        score = ((counts - mu) * w).sum(axis=1)
        fisher = (mu * w).sum(axis=1)
        log = log + np.clip(score / np.maximum(fisher, 1e-12), -2, 2)
    return np.where(some, np.exp(log), 0.0)


def _fit(counts: np.ndarray, factors: np.ndarray, second: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(adjusted log likelihood, mean of either condition, variance of the log ratio)."""
    means, weights = [], []
    total = np.zeros(len(counts))
    for part in (~second, second):
        k, s = counts[:, part], factors[part]
        q = group_mean(k, s, alpha)
        mu = np.maximum(q[:, None] * s, 1e-10)
        size = 1 / alpha[:, None]
        total += (log_gamma(k + size) - log_gamma(np.broadcast_to(size, k.shape)) - k * np.log1p(size / mu) - size * np.log1p(alpha[:, None] * mu)).sum(axis=1)
        held = np.maximum(mu, MIN_MEAN)
        weights.append((held / (1 + alpha[:, None] * held)).sum(axis=1))
        means.append(q)
    return total - 0.5 * np.log(weights[0] * weights[1]), means[0], means[1], 1 / weights[0] + 1 / weights[1]


def dispersions(counts: np.ndarray, factors: np.ndarray, second: np.ndarray, prior: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """The dispersion of each row of greatest adjusted likelihood, times a prior of (logarithm
    of the trend, variance) where one is given: on a grid, then between its steps."""
    grid = np.linspace(np.log(LEAST), np.log(MOST), STEPS)
    values = np.empty((len(counts), STEPS))
    for i, x in enumerate(grid):
        values[:, i] = _fit(counts, factors, second, np.full(len(counts), np.exp(x)))[0]
        if prior is not None:
            values[:, i] -= (x - prior[0]) ** 2 / (2 * prior[1])
    best = np.clip(values.argmax(axis=1), 1, STEPS - 2)
    rows = np.arange(len(counts))
    left, top, right = (values[rows, best + d] for d in (-1, 0, 1))
    bend = left - 2 * top + right
    shift = np.where(bend < 0, 0.5 * (left - right) / np.where(bend < 0, bend, 1), 0.0)
    at_edge = values.argmax(axis=1) == 0
    return np.where(at_edge, LEAST, np.exp(grid[best] + np.clip(shift, -1, 1) * (grid[1] - grid[0])))


def fit_trend(mean: np.ndarray, alpha: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a0, a1) of alpha = a0 + a1 / mean, both at least 0, of least relative error; steps far
    from the fit count no more."""
    use = (alpha > 100 * LEAST) & (mean > 0)
    a = np.array([0.1, 1.0])
    for _ in range(20):
        if use.sum() < 2:
            return (float(np.median(alpha[alpha > 0])) if (alpha > 0).any() else LEAST, 0.0)
        x = np.stack([np.ones(int(use.sum())), 1 / mean[use]], axis=1)
        scale = np.sqrt(weight[use]) / np.maximum(x @ a, 1e-10)
        new = np.linalg.lstsq(x * scale[:, None], alpha[use] * scale, rcond=None)[0]
        if (new < 0).any():
            new = np.array([max(np.average(alpha[use], weights=weight[use]), LEAST), 0.0]) if new[1] < 0 else np.array([LEAST, max(float(new[1]), 0.0)])
        ratio = alpha / np.maximum(new[0] + new[1] / np.maximum(mean, 1e-10), 1e-12)
        use = (alpha > 100 * LEAST) & (mean > 0) & (ratio > 1e-4) & (ratio < 15)
        if np.abs(new - a).max() < 1e-6:
            break
        a = new
    return float(max(new[0], LEAST)), float(new[1])


def differential(counts: DataFrame, conditions: DataFrame, reference: str) -> DataFrame:
    """feature, base_mean, log2_fold_change (against reference), se, stat, p, padj, dispersion.

    counts: feature, sample, count (no row is no count); conditions: sample, condition, two of
    them, a small table. Features without counts have nulls. Runs jobs; of features only one row
    for each step of the mean reaches the driver."""
    names = [(r["sample"], r["condition"]) for r in conditions.orderBy("sample").limit(MAX_SAMPLES + 1).collect()]
    if len(names) > MAX_SAMPLES:
        raise ValueError("too many samples for one row of counts a feature")
    if len({c for _, c in names}) != 2 or reference not in {c for _, c in names}:
        raise ValueError("two conditions are needed, one of them the reference")
    spark = counts.sparkSession
    factor_of = {r["sample"]: r["factor"] for r in size_factors(counts).collect()}
    factors = np.array([factor_of.get(s) or 1.0 for s, _ in names])
    second = np.array([c != reference for _, c in names])
    place = F.broadcast(spark.createDataFrame([(s, i) for i, (s, _) in enumerate(names)], "sample string, place int"))
    held = counts.join(place, "sample").groupBy("feature").agg(F.collect_list(F.struct("place", F.col("count").cast("double").alias("c"))).alias("a"))
    kind = dict(counts.dtypes)["feature"]
    n = len(names)

    def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
        lists = batch.column(column)
        out = np.zeros((batch.num_rows, n))
        values = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        np.add.at(out, (row, values.field("place").to_numpy()), values.field("c").to_numpy())
        return out

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                k = matrix(pa.RecordBatch.from_arrays([part.column(0), pa.concat_arrays([part.column(1)])], names=part.schema.names), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((k / factors).mean(axis=1)), pa.array(dispersions(k, factors, second))], names=["feature", "a", "base_mean", "own"])

    # Read by every pass below; what memory cannot hold goes to disk, what is lost is made anew.
    fitted = held.mapInArrow(own, f"feature {kind}, a array<struct<place:int,c:double>>, base_mean double, own double").persist()
    step = F.round(F.ln("base_mean") * 4)
    binned = fitted.where("base_mean > 0").groupBy(step.alias("step")).agg(F.expr("percentile_approx(base_mean, 0.5)").alias("m"), F.expr("percentile_approx(own, 0.5)").alias("a"), F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    if not binned:
        none = F.lit(None).cast("double")
        return fitted.select("feature", "base_mean", *(none.alias(c) for c in ("log2_fold_change", "se", "stat", "p", "padj", "dispersion")))
    a0, a1 = fit_trend(np.array([r["m"] for r in binned]), np.array([r["a"] for r in binned]), np.array([r["n"] for r in binned], float))
    rest = F.ln(F.greatest("own", F.lit(LEAST))) - F.ln(F.lit(a0) + F.lit(a1) / F.col("base_mean"))
    wide = fitted.where(f"base_mean > 0 AND own > {100 * LEAST}").select(rest.alias("r"))
    middle = wide.agg(F.expr("percentile_approx(r, 0.5)")).first()[0]
    spread = 1.0 if middle is None else wide.agg(F.expr(f"percentile_approx(abs(r - ({middle})), 0.5)")).first()[0] * 1.4826
    variance = max(spread**2 - trigamma(max(n - 2, 1) / 2), 0.25)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                k = matrix(pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(1)])], names=["a"]), 0)
                mean, mine = part.column(2).to_numpy(), part.column(3).to_numpy()
                trend = np.log(a0 + a1 / np.maximum(mean, 1e-10))
                alpha = dispersions(k, factors, second, (trend, variance))
                alpha = np.where(np.log(np.maximum(mine, LEAST)) > trend + 2 * spread, mine, alpha)
                _, qa, qb, var = _fit(k, factors, second, alpha)
                floor = MIN_MEAN / factors.sum()
                ratio = np.log(np.maximum(qb, floor) / np.maximum(qa, floor))
                se = np.sqrt(var)
                empty = mean <= 0
                columns = [ratio / np.log(2), se / np.log(2), ratio / se, alpha]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(np.where(empty, np.nan, c), mask=empty) for c in columns)], names=["feature", "base_mean", "log2_fold_change", "se", "stat", "dispersion"])

    tested = fitted.mapInArrow(final, f"feature {kind}, base_mean double, log2_fold_change double, se double, stat double, dispersion double").withColumn("p", _two_sided(F.col("stat")))
    adjusted = benjamini_hochberg(tested.where("p IS NOT NULL").select("feature", "p"))
    return tested.join(adjusted.select("feature", "padj"), "feature", "left").select("feature", "base_mean", "log2_fold_change", "se", "stat", "p", "padj", "dispersion")
