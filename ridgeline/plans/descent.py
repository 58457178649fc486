"""The small numeric step inside one path cell: coordinate descent on cross-products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ridgeline.operators.scatter import Scatter

# Fixed value: smallest mixing weight used to build a penalty grid when alpha is 0.
GRID_ALPHA_FLOOR = 1e-3


@dataclass(frozen=True)
class PathConfig:
    """One path to solve: a mixing weight with its grid and stopping rule."""

    alpha: float = 0.01
    num_lambdas: int = 100
    lambda_shrink: float = 1e-3
    tol: float = 1e-3
    max_iter: int = 100
    fit_intercept: bool = True
    entry: str = "full"  # "lagged": cross terms of a new feature count only after a first pass

    def __post_init__(self):
        if not 0.0 <= self.alpha <= 1.0:
            raise ValueError("alpha must lie in [0, 1]")
        if self.num_lambdas < 1 or self.max_iter < 0 or self.tol < 0:
            raise ValueError("num_lambdas must be positive, max_iter and tol not negative")
        if self.lambda_shrink <= 0:
            raise ValueError("lambda_shrink must be positive")
        if self.entry not in ("full", "lagged"):
            raise ValueError("entry must be 'full' or 'lagged'")


@dataclass
class Scaled:
    """Standardized view of a training set: everything a path needs, without its rows."""

    n: float
    mean: np.ndarray  # label first
    std: np.ndarray
    xy: np.ndarray
    xx: np.ndarray


def sample_std(total: Scatter) -> np.ndarray:
    """Sample standard deviation per slot; exactly 0 for a constant column or one row."""
    if total.n <= 1:
        return np.zeros(len(total.mean))
    spread = np.sqrt(np.maximum(np.diag(total.c), 0.0) / (total.n - 1))
    return np.where(total.low == total.high, 0.0, spread)


def scale(total: Scatter, fit_intercept: bool = True) -> Scaled:
    """Fold the standardization into the moments instead of into the rows."""
    std = sample_std(total)
    square = total.c if fit_intercept else total.c + total.n * np.outer(total.mean, total.mean)
    inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    products = square * inverse[:, None] * inverse[None, :] / total.n
    return Scaled(total.n, total.mean, std, products[0, 1:].copy(), products[1:, 1:].copy())


def lambda_grid(top: float, config: PathConfig) -> np.ndarray:
    """Geometric grid below ``top / alpha``; the starting value itself is left out."""
    ratio = config.lambda_shrink ** (1.0 / config.num_lambdas)
    start = top / max(config.alpha, GRID_ALPHA_FLOOR)
    return start * ratio ** np.arange(1, config.num_lambdas + 1)


SPARSE_SWEEP = 16  # jump from mover to mover when at most one coefficient in so many is nonzero


def sweep(g: np.ndarray, beta: np.ndarray, xx: np.ndarray, gamma: float, ridge: float) -> float:
    """One ascending pass over all coordinates. ``g`` stays ``xy - xx beta``; returns the change."""
    change, j, width = 0.0, 0, len(beta)
    sparse = np.count_nonzero(beta) * SPARSE_SWEEP < width
    while j < width:
        if sparse:
            # a zero coefficient within the threshold stays zero: look up the next one that can move
            movable = (beta[j:] != 0.0) | (np.abs(g[j:]) > gamma)
            step = int(movable.argmax())
            if not movable[step]:
                break
            j += step
        old = beta[j]
        z = g[j] + old
        new = 0.0 if abs(z) <= gamma else (z - gamma if z > 0 else z + gamma) / ridge
        if new != old:
            g -= xx[j] * (new - old)
            beta[j] = new
            change += abs(new - old)
        j += 1
    return change


@dataclass
class PathPoint:
    index: int
    lam: float
    beta: np.ndarray
    passes: int
    converged: bool


def solve_path(xy: np.ndarray, xx: np.ndarray, lambdas: np.ndarray, config: PathConfig) -> list[PathPoint]:
    """Warm-started path over decreasing penalties."""
    beta = np.zeros(len(xy))
    lagged = config.entry == "lagged"
    gram = xx
    if lagged:
        known = np.abs(xy) > lambdas[0] * config.alpha
        gram = np.where(known[:, None], xx, 0.0)
    points = []
    for index, lam in enumerate(lambdas):
        gamma, ridge = lam * config.alpha, 1.0 + lam * (1.0 - config.alpha)
        g = xy - beta @ gram
        passes, converged = 0, False
        while passes < config.max_iter and not converged:
            change = sweep(g, beta, gram, gamma, ridge)
            passes += 1
            if lagged and passes == 1:
                fresh = (beta != 0) & ~known
                if fresh.any():
                    known |= fresh
                    gram = np.where(known[:, None], xx, 0.0)
                    g = xy - beta @ gram
            converged = change <= config.tol * np.abs(beta).sum()
        points.append(PathPoint(index, float(lam), beta.copy(), passes, converged))
    return points


def original_scale(beta: np.ndarray, mean: np.ndarray, std: np.ndarray, fit_intercept: bool, label_std: float):
    """Weights and intercept on the scale of the input; a constant feature gets weight 0."""
    factor = np.divide(label_std, std[1:], out=np.zeros(len(beta)), where=std[1:] > 0)
    weights = beta * factor + 0.0
    intercept = float(mean[0] - weights @ mean[1:]) if fit_intercept else 0.0
    return weights, intercept
