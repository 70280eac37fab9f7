"""Robust estimation: samplers, support measures and the RANSAC family."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np


class Estimator(Protocol):
    """What a model must offer to be fitted robustly."""

    least: int

    def fit(self, x: np.ndarray, y: np.ndarray) -> list: ...

    def residuals(self, model, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...


def trials(inliers: int, samples: int, confidence: float, least: int = 3) -> int:
    """Trials until one sample is free of outliers with this confidence."""
    ratio = inliers / samples
    if confidence >= 1:
        return 2**63 - 1
    wrong, miss = 1 - confidence, 1 - ratio**least
    if wrong <= 0:
        return 2**63 - 1
    if miss <= 0:
        return 1
    if miss == 1:
        return 2**63 - 1
    return max(1, math.ceil(math.log(wrong) / math.log(miss)))


# Samplers -----------------------------------------------------------------------


def random_samples(n: int, k: int, seed: int = 0) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed)
    while True:
        yield rng.choice(n, k, replace=False)


def all_samples(n: int, k: int) -> Iterator[np.ndarray]:
    """Every combination once, in lexicographic order."""
    return (np.array(c) for c in itertools.combinations(range(n), k))


def progressive_samples(quality: np.ndarray, k: int, seed: int = 0, rounds: int = 200_000) -> Iterator[np.ndarray]:
    """Samples from a growing set of the best data; the newest is always in."""
    rng, order, n = np.random.default_rng(seed), np.argsort(-quality, kind="stable"), len(quality)
    expected = float(rounds)
    for i in range(k):
        expected *= (k - i) / (n - i)
    size, until, t = k, 1.0, 0
    while True:
        t += 1
        while t > until and size < n:
            nxt = expected * (size + 1) / (size + 1 - k)
            until += max(1.0, nxt - expected)
            expected, size = nxt, size + 1
        if size < n or t <= until:
            yield order[np.append(rng.choice(size - 1, k - 1, replace=False), size - 1)]
        else:
            yield order[rng.choice(size, k, replace=False)]


# Support --------------------------------------------------------------------------


def inlier_support(residuals: np.ndarray, most: float) -> tuple:
    """More inliers, then a smaller sum of their residuals."""
    good = residuals <= most
    return int(good.sum()), -float(residuals[good].sum())


def capped_support(residuals: np.ndarray, most: float) -> tuple:
    """Smaller sum of residuals capped at the bound (M-estimator)."""
    return (-float(np.minimum(residuals, most).sum()),)


def median_support(residuals: np.ndarray, most: float) -> tuple:
    """Smaller median residual (least median of squares)."""
    return (-float(np.median(residuals)),)


def ransac(estimator, x, y, most: float, *, confidence: float = 0.99, min_trials: int = 1, max_trials: int = 10_000, min_ratio: float = 0.1, support: Callable = inlier_support, samples=None, local: int = 0, seed: int = 0):
    """(model, inlier mask, trials) or None.

    ``most`` bounds squared residuals. With ``local`` rounds the best model is
    refitted to all its inliers while that helps (locally optimised).
    """
    n = len(x)
    if n < estimator.least:
        return None
    samples = samples or random_samples(n, estimator.least, seed)
    limit, done = min(max_trials, trials(max(1, int(min_ratio * n)), n, confidence, estimator.least)), 0
    best = None
    for pick in samples:
        if done >= max(limit, min_trials):
            break
        done += 1
        for model in estimator.fit(x[pick], y[pick]):
            residuals = estimator.residuals(model, x, y)
            score = support(residuals, most)
            if best is None or score > best[0]:
                best = score, model, residuals <= most
                for _ in range(local):
                    if best[2].sum() <= estimator.least:
                        break
                    refits = [(support(r := estimator.residuals(m, x, y), most), m, r <= most) for m in estimator.fit(x[best[2]], y[best[2]])]
                    better = max(refits, key=lambda z: z[0], default=None)
                    if better is None or better[0] <= best[0]:
                        break
                    best = better
                if best[2].sum():
                    limit = min(max_trials, trials(int(best[2].sum()), n, confidence, estimator.least))
    if best is None or best[2].sum() < estimator.least:
        return None
    return best[1], best[2], done


def sprt_reject(residuals: np.ndarray, most: float, good: float = 0.5, bad: float = 0.05, threshold: float = 100.0) -> bool:
    """Sequential probability ratio test: whether a model is rejected early."""
    ratio = 1.0
    for r in residuals:
        ratio *= bad / good if r <= most else (1 - bad) / (1 - good)
        if ratio > threshold:
            return True
    return False


# Linear problems ---------------------------------------------------------------------


def least_absolute(a, b: np.ndarray, rounds: int = 100, rho: float = 1.0, alpha: float = 1.0, solve: Callable | None = None) -> np.ndarray:
    """Minimise |Ax - b| by ADMM with one factorisation.

    A sparse ``a`` is given by its product with a vector, and ``solve`` then by the least
    squares solution for a right side.
    """
    if solve is None:
        matrix, inverse = a, np.linalg.pinv(a)
        a, solve = lambda x: matrix @ x, lambda b: inverse @ b
    x, z, u = solve(b), np.zeros(len(b)), np.zeros(len(b))
    for _ in range(rounds):
        x = solve(b + z - u)
        ax = alpha * a(x) + (1 - alpha) * (z + b)
        v = ax - b + u
        new = np.sign(v) * np.maximum(np.abs(v) - 1 / rho, 0)
        u += ax - new - b
        if np.abs(new - z).max(initial=0) < 1e-10:
            break
        z = new
    return x


def quadratic_program(p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 500, rho: float = 1.0) -> np.ndarray:
    """Minimise x'Px/2 + q'x within bounds by ADMM."""
    solve = np.linalg.inv(p + rho * np.eye(len(q)))
    z, u = np.clip(np.zeros(len(q)), low, high), np.zeros(len(q))
    for _ in range(rounds):
        x = solve @ (rho * (z - u) - q)
        new = np.clip(x + u, low, high)
        u += x - new
        if np.abs(new - z).max() < 1e-12:
            break
        z = new
    return z


def conjugate_gradient(apply: Callable, b: np.ndarray, rounds: int = 500, tolerance: float = 1e-12) -> np.ndarray:
    """Solve a symmetric positive system given by its product with a vector."""
    x = np.zeros_like(b)
    r = b - apply(x)
    p, rr = r.copy(), float(r @ r)
    for _ in range(rounds):
        if rr <= tolerance:
            break
        ap = apply(p)
        k = rr / float(p @ ap)
        x, r = x + k * p, r - k * ap
        new = float(r @ r)
        p, rr = r + new / rr * p, new
    return x


def polynomial_roots(coefficients) -> np.ndarray:
    """All complex roots, highest coefficient first (companion matrix)."""
    c = np.trim_zeros(np.asarray(coefficients, dtype=float), "f")
    if len(c) < 2:
        return np.empty(0, dtype=complex)
    companion = np.diag(np.ones(len(c) - 2), -1)
    companion[0] = -c[1:] / c[0]
    return np.linalg.eigvals(companion)


def rq(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangular times orthogonal, with a positive diagonal."""
    flip = np.eye(len(m))[::-1]
    q, r = np.linalg.qr((flip @ m).T)
    r, q = flip @ r.T @ flip, flip @ q.T
    sign = np.diag(np.where(np.diag(r) < 0, -1.0, 1.0))
    return r @ sign, sign @ q
