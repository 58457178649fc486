"""Elastic-net paths of logistic models: one Spark job per reweighting round for all cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ridgeline.operators.anchored import anchored_products, merge_anchored
from ridgeline.operators.design import Design, cache_packed, design, first_width
from ridgeline.operators.grid import LOGISTIC_STEP
from ridgeline.operators.moments import _typed
from ridgeline.operators.scatter import BLOCK_CELLS
from ridgeline.operators.weighted import SALTS, State, add_bands, merge_bands, weighted_partials
from ridgeline.plans.active_logistic import active_logistic_cells
from ridgeline.plans.descent import GRID_ALPHA_FLOOR
from ridgeline.plans.lazy import densify
from ridgeline.plans.linear import ALL_ROWS

LOGISTIC_SCHEMA = (
    "fold int, cell int, alpha double, lambda_idx int, lambda double, intercept double, "
    "weights array<double>, beta0 double, beta array<double>, rounds int, converged boolean, n bigint"
)
STEP_SCHEMA = "cell int, beta0 double, beta array<double>, distance double, next0 double, next array<double>"
STATE_CELLS = 2**26  # doubles of weighted products that one task may hold: 512 MB
FULL_WIDTH = 256  # features whose products are all added up, unless asked otherwise
DENOMINATOR_GUARD = 1e-4  # fixed value in the relative change of a reweighting step


@dataclass(frozen=True)
class LogisticConfig:
    """One logistic path. ``lambda_shrink`` replaces the fixed grid step when given."""

    alpha: float = 1.0
    num_lambdas: int = 100
    lambda_shrink: float | None = None
    step: float = LOGISTIC_STEP
    tol: float = 0.01  # reweighting stops at this relative change
    inner_tol: float = 0.01
    max_iter: int = 100  # passes per reweighting step
    max_rounds: int = 25  # reweighting steps per penalty
    fit_intercept: bool = True
    freeze_intercept: bool = False  # keep the score intercept at its start value
    carry_step: bool = True  # a converged round also takes the first step of the next penalty

    def __post_init__(self):
        if not 0.0 <= self.alpha <= 1.0:
            raise ValueError("alpha must lie in [0, 1]")
        if self.num_lambdas < 1 or self.max_iter < 1 or self.max_rounds < 1:
            raise ValueError("num_lambdas, max_iter and max_rounds must be positive")

    def lambdas(self, top: float) -> np.ndarray:
        ratio = self.step if self.lambda_shrink is None else self.lambda_shrink ** (1.0 / self.num_lambdas)
        return top / max(self.alpha, GRID_ALPHA_FLOOR) * ratio ** np.arange(1, self.num_lambdas + 1)


@dataclass(frozen=True)
class Basis:
    """Scale of one training set, label first, and its products with the label."""

    fold: int
    n: float
    mean: np.ndarray
    std: np.ndarray
    product: np.ndarray


@dataclass
class Cell:
    """Progress of one (fold, alpha) cell; the driver holds only its coefficients."""

    fold: int
    number: int
    config: LogisticConfig
    n: float
    mean: np.ndarray  # label first
    std: np.ndarray
    lambdas: np.ndarray
    beta0: float
    beta: np.ndarray
    index: int = 0
    rounds: int = 0
    points: list[tuple] = field(default_factory=list)

    @property
    def done(self) -> bool:
        return self.index >= len(self.lambdas)

    @property
    def following(self) -> float | None:
        """The penalty after the current one."""
        return float(self.lambdas[self.index + 1]) if self.index + 1 < len(self.lambdas) else None

    def record(self, converged: bool) -> None:
        lam = float(self.lambdas[self.index])
        centred = self.config.fit_intercept
        weights = np.divide(self.beta, self.std[1:], out=np.zeros(len(self.beta)), where=self.std[1:] > 0) + 0.0
        intercept = float(self.beta0 - weights @ self.mean[1:]) if centred else 0.0
        self.points.append(
            (
                self.fold,
                self.number,
                self.config.alpha,
                self.index,
                None if np.isnan(lam) else lam,
                intercept,
                weights.tolist(),
                float(self.beta0),
                (self.beta + 0.0).tolist(),
                self.rounds,
                converged,
                int(self.n),
            )
        )
        self.index, self.rounds = self.index + 1, 0


def logistic_path(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    alphas: Sequence[float] = (1.0,),
    *,
    fold: Column | str | None = None,
    num_folds: int = 0,
    handle_invalid: str = "error",
    mode: str = "auto",
    journal: str | None = None,
    **options,
) -> DataFrame:
    """Fit a path of penalized logistic models for a 0/1 label, one per (fold, alpha) cell.

    ``mode="full"`` adds up weighted products of all features, ``mode="active"`` those of active features and checks
    the gradient of all others; ``auto`` takes the latter beyond ``FULL_WIDTH`` features. With ``journal``, a folder
    that all executors share, a stopped fit of active features goes on from its last finished round.
    """
    configs = [LogisticConfig(alpha=float(a), **options) for a in alphas]
    return logistic_cells(df, label, features, configs, fold, num_folds, handle_invalid, mode, journal)


def logistic_cells(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    configs: Sequence[LogisticConfig],
    fold: Column | str | None = None,
    num_folds: int = 0,
    handle_invalid: str = "error",
    mode: str = "full",
    journal: str | None = None,
) -> DataFrame:
    """Paths with dense ``weights`` and ``beta``; see ``sparse_logistic_path`` for features beyond counting."""
    frame, num_folds = logistic_design(df, label, features, fold, num_folds, handle_invalid)
    if mode not in ("auto", "full", "active"):
        raise ValueError("mode must be auto, full or active")
    if mode == "active" or (mode == "auto" and first_width(frame) > FULL_WIDTH):
        return densify(active_logistic_cells(frame, configs, num_folds, STATE_CELLS, journal))
    return full_cells(frame, configs, num_folds)


def sparse_logistic_path(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    alphas: Sequence[float] = (1.0,),
    *,
    fold: Column | str | None = None,
    num_folds: int = 0,
    handle_invalid: str = "error",
    journal: str | None = None,
    **options,
) -> DataFrame:
    """The path of active features with sparse weights (``indices, weights, width``), for any number of features."""
    configs = [LogisticConfig(alpha=float(a), **options) for a in alphas]
    frame, num_folds = logistic_design(df, label, features, fold, num_folds, handle_invalid)
    return active_logistic_cells(frame, configs, num_folds, STATE_CELLS, journal)


def logistic_design(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    fold: Column | str | None,
    num_folds: int,
    handle_invalid: str,
) -> tuple[Design, int]:
    """The checked input, and its number of folds (0 without a fold)."""
    if fold is None:
        num_folds = 0
    elif num_folds < 2:
        raise ValueError("num_folds must be at least 2 when a fold column is given")
    target = (F.col(label) if isinstance(label, str) else label).cast("double")
    unknown = F.raise_error(F.lit("a logistic label must be 0 or 1")).cast("double")
    target = F.when(target.isNull() | F.isnan(target) | target.isin(0.0, 1.0), target).otherwise(unknown)
    return design(df, target, features, fold, handle_invalid, num_folds or None), num_folds


def full_cells(frame: Design, configs: Sequence[LogisticConfig], num_folds: int) -> DataFrame:
    """One job for each reweighting round of all cells, over products of all features."""
    spark = frame.rows.sparkSession
    frame, held = cache_packed(frame)
    rows = frame.rows
    try:
        basis = cell_basis(anchored_products(frame, [0]), num_folds)
        cells = [make_cell(b, number, config) for b in basis for number, config in enumerate(configs)]
        if not cells:
            return spark.createDataFrame([], LOGISTIC_SCHEMA)
        shared = basis[0]  # all rows
        centre, spread = shared.mean[1:], shared.std[1:]
        at_once = max(1, STATE_CELLS // (len(centre) + 2) ** 2)
        salts = SALTS if rows.rdd.getNumPartitions() > 8 * SALTS else 1
        while waiting := [c for c in cells if not c.done]:
            for first in range(0, len(waiting), at_once):
                one_round(rows, frame.columns, centre, spread, waiting[first : first + at_once], salts)
    finally:
        for table in held:
            table.unpersist()
    return spark.createDataFrame([p for c in cells for p in c.points], LOGISTIC_SCHEMA)


def cell_basis(table: DataFrame, num_folds: int) -> list[Basis]:
    """Training means, deviations and start products per fold: a few vectors, no matrices."""
    folds = range(ALL_ROWS, num_folds)
    spread = table.withColumnRenamed("fold", "source").withColumn("fold", F.explode(F.array(*[F.lit(k) for k in folds])))
    train = merge_anchored(spread.where("fold <> source").select(table.columns))
    parts: dict[int, list] = {}
    for row in train.collect():
        parts.setdefault(row["fold"], []).append(row)
    basis = []
    for fold, rows in sorted(parts.items()):
        rows.sort(key=lambda r: r["start"])
        n = rows[0]["n"]
        mean, low, high, square, product = (
            np.concatenate([np.array(r[k]) for r in rows]) for k in ("mean", "low", "high", "square", "c")
        )
        std = np.where(low == high, 0.0, np.sqrt(square / max(n - 1, 1)))
        inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        basis.append(Basis(fold, n, mean, std, (product * inverse / n)[1:]))
    return basis


def make_cell(basis: Basis, number: int, config: LogisticConfig) -> Cell:
    mean, std, product = basis.mean, basis.std, basis.product
    beta = np.zeros(len(product))
    share = float(mean[0])
    if std[0] == 0.0:
        # one class only: nothing to search; the score saturates at the guard probability
        share = min(max(share, 1e-5), 1.0 - 1e-5)
        lambdas = np.full(config.num_lambdas, np.nan)
    else:
        lambdas = config.lambdas(float(np.abs(product).max()))
    moving = config.fit_intercept and not config.freeze_intercept
    beta0 = float(np.log(share / (1.0 - share))) if moving else 0.0
    cell = Cell(basis.fold, number, config, basis.n, mean, std, lambdas, beta0, beta)
    if std[0] == 0.0:
        while not cell.done:
            cell.record(True)
    return cell


def one_round(
    rows: DataFrame,
    columns: list[str],
    centre: np.ndarray,
    spread: np.ndarray,
    cells: Sequence[Cell],
    salts: int = 1,
) -> None:
    """One reweighting step of every unfinished cell, in one job over the cached rows."""
    states, frames = [], []
    for number, cell in enumerate(cells):
        mean = cell.mean[1:] if cell.config.fit_intercept else np.zeros(len(centre))
        usable = (cell.std[1:] > 0) & (spread > 0)
        scale = np.divide(cell.std[1:], spread, out=np.ones_like(spread), where=usable)
        shift = np.divide(mean - centre, spread, out=np.zeros_like(spread), where=usable)
        slopes = np.where(usable, cell.beta / scale, 0.0)
        states.append(State(number, cell.fold, cell.beta0 - float(slopes @ shift), slopes))
        frames.append((shift, np.where(usable, 1.0 / scale, 0.0)))
    todo = [
        (c.config, float(c.lambdas[c.index]), c.following, c.n, c.beta0, c.beta, shift, inverse)
        for c, (shift, inverse) in zip(cells, frames)
    ]

    def step(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = keys[0].as_py()
        config, lam, ahead, n, beta0, beta, shift, inverse = todo[number]
        bands = add_bands(batches)
        width = len(beta) + 1
        joined = np.concatenate([bands[key] for key in sorted(bands)]).reshape(width, width + 1)
        gram, target = rescaled(joined[:, :width], joined[:, width], shift, inverse)
        new0, new = penalized_step(gram, target, n, beta0, beta, lam, config)
        distance = relative_change(beta0, beta, new0, new, config)
        next0, after = None, None
        if distance <= config.tol and ahead is not None and config.carry_step:
            # the products are current to within the tolerance, so the next penalty can start on
            # them; the following round corrects that step and saves one scan per penalty
            next0, after = penalized_step(gram, target, n, new0, new, ahead, config)
        vectors = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int32()),
                pa.array([new0], pa.float64()),
                pa.array([new.tolist()], vectors),
                pa.array([distance], pa.float64()),
                pa.array([next0], pa.float64()),
                pa.array([None if after is None else after.tolist()], vectors),
            ],
            names=["cell", "beta0", "beta", "distance", "next0", "next"],
        )

    partials = weighted_partials(rows, columns, centre, spread, states, salts)
    if salts > 1 or (len(centre) + 1) * (len(centre) + 2) > BLOCK_CELLS:
        partials = merge_bands(partials)
    solved = partials.groupBy("cell").applyInArrow(_typed(step), STEP_SCHEMA).collect()
    for row in solved:
        cell = cells[row["cell"]]
        cell.beta0, cell.beta = row["beta0"], np.array(row["beta"])
        cell.rounds += 1
        converged = row["distance"] <= cell.config.tol
        if converged or cell.rounds >= cell.config.max_rounds:
            cell.record(converged)
            if row["next"] is not None:
                cell.beta0, cell.beta = row["next0"], np.array(row["next"])


def rescaled(
    gram: np.ndarray, target: np.ndarray, shift: np.ndarray, inverse: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Products of features on the common scale as those of ``(feature - shift) * inverse``; slot 0 is the constant."""
    gram, target = gram.copy(), target.copy()
    gram[1:] = (gram[1:] - shift[:, None] * gram[0]) * inverse[:, None]
    gram[:, 1:] = (gram[:, 1:] - gram[:, :1] * shift) * inverse
    target[1:] = (target[1:] - shift * target[0]) * inverse
    return gram, target


def penalized_step(
    gram: np.ndarray,
    target: np.ndarray,
    n: float,
    beta0: float,
    beta: np.ndarray,
    lam: float,
    config: LogisticConfig,
) -> tuple[float, np.ndarray]:
    """Coordinate passes at fixed weights; the residual sums replace a pass over the rows."""
    beta = beta.copy()
    gamma, ridge = lam * config.alpha, lam * (1.0 - config.alpha)
    rest = target - gram[:, 0] * beta0 - gram[:, 1:] @ beta
    start0 = beta0
    for _ in range(config.max_iter):
        change = 0.0
        for j in range(1, len(rest)):
            wxr, wxx = rest[j] / n, gram[j, j] / n
            if config.fit_intercept:
                move0 = rest[0] / gram[0, 0]
                beta0 += move0
                rest -= gram[:, 0] * move0
            if wxx <= 0.0:
                continue
            old = beta[j - 1]
            z = wxr + wxx * old
            new = 0.0 if abs(z) <= gamma else (z - gamma if z > 0 else z + gamma) / (wxx + ridge)
            if new != old:
                rest -= gram[:, j] * (new - old)
                beta[j - 1] = new
                change += abs(new - old)
        if change <= config.inner_tol * np.abs(beta).sum():
            break
    if config.freeze_intercept:
        beta0 = start0
    return beta0, beta


def relative_change(
    old0: float, old: np.ndarray, new0: float, new: np.ndarray, config: LogisticConfig
) -> float:
    change, size = np.abs(new - old).sum(), np.abs(old).sum()
    if config.fit_intercept and not config.freeze_intercept:
        change, size = change + abs(new0 - old0), size + abs(old0)
    return float(change / (size + DENOMINATOR_GUARD))
