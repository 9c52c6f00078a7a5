"""Negative-binomial models on simulated counts."""

import math

import numpy as np
import pytest

from endloom.operators import differential as D


def test_special_functions():
    x = np.array([1e-6, 0.3, 1.0, 2.5, 40.0, 1e5])
    assert np.allclose(D.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    assert D.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-7) and D.trigamma(0.5) == pytest.approx(math.pi**2 / 2, rel=1e-7)


def test_group_mean_is_the_maximum():
    rng = np.random.default_rng(0)
    k, s, alpha = rng.negative_binomial(4, 0.1, (30, 5)).astype(float), rng.uniform(0.5, 2, 5), rng.uniform(0.01, 1, 30)
    q = D.group_mean(k, s, alpha)

    def likelihood(m):
        mu, size = m[:, None] * s, 1 / alpha[:, None]
        return (k * np.log(mu) - (k + size) * np.log(size + mu)).sum(axis=1)

    assert (likelihood(q) >= likelihood(q * 1.001)).all() and (likelihood(q) >= likelihood(q * 0.999)).all()
    assert D.group_mean(np.zeros((1, 5)), s, alpha[:1])[0] == 0


def test_dispersions_are_found_on_average():
    rng = np.random.default_rng(1)
    second = np.array([False] * 6 + [True] * 6)
    for alpha in (0.05, 0.5):
        k = rng.negative_binomial(1 / alpha, 1 / (1 + alpha * 200), (400, 12)).astype(float)
        found = D.dispersions(k, np.ones(12), second)
        assert 0.8 < np.median(found) / alpha < 1.2
    drawn = D.dispersions(k, np.ones(12), second, (np.full(400, np.log(0.5)), 0.05))
    assert np.std(np.log(drawn)) < 0.5 * np.std(np.log(found))


def test_trend():
    mean = np.array([5.0, 20, 100, 1000, 5000])
    a0, a1 = D.fit_trend(mean, 0.1 + 3 / mean, np.ones(5))
    assert a0 == pytest.approx(0.1, rel=1e-3) and a1 == pytest.approx(3, rel=1e-3)


def test_differential_finds_what_changes(spark):
    rng = np.random.default_rng(2)
    base, n = rng.uniform(30, 2000, 300), 8
    depth = rng.uniform(0.6, 1.6, n)
    fold = np.ones(300)
    fold[:30], fold[30:60] = 4, 0.25  # as many up as down, or the size factors shift
    rows = []
    for g in range(300):
        alpha = 0.05 + 2 / base[g]
        for j in range(n):
            mu = base[g] * depth[j] * (fold[g] if j >= n // 2 else 1)
            rows.append((f"g{g:03d}", f"s{j}", int(rng.negative_binomial(1 / alpha, 1 / (1 + alpha * mu)))))
    rows.append(("zero", "s0", 0))
    counts = spark.createDataFrame(rows, "feature string, sample string, count long")
    conditions = spark.createDataFrame([(f"s{j}", "b" if j >= n // 2 else "a") for j in range(n)], "sample string, condition string")
    out = {r["feature"]: r for r in D.differential(counts, conditions, "a").collect()}
    assert len(out) == 301 and out["zero"]["p"] is None and out["zero"]["padj"] is None
    called = np.array([out[f"g{g:03d}"]["padj"] < 0.05 for g in range(300)])
    assert called[:60].mean() > 0.9 and called[60:].mean() < 0.06
    shift = np.array([out[f"g{g:03d}"]["log2_fold_change"] for g in range(300)])
    assert abs(np.median(shift[:30]) - 2) < 0.3 and abs(np.median(shift[30:60]) + 2) < 0.3 and abs(np.median(shift[60:])) < 0.1
    p = np.array([out[f"g{g:03d}"]["p"] for g in range(60, 300)])
    assert 0.01 < (p < 0.05).mean() < 0.12  # the test keeps its level under no change
    with pytest.raises(ValueError):
        D.differential(counts, conditions, "c")
