"""Paths for wide inputs: cross-products only for features that are about to enter.

Three jobs make a round:

* *solve*: every open path is solved on its active features alone, a few penalties ahead, one task per path, which
  reads products of active features with active features only;
* *check*: the left-out features are checked against those points where their products lie, chunk by chunk of the
  feature axis, and only features that break the optimality conditions come back;
* *grow*: products of the new features with all others, in one pass over the rows, stored by chunk.

A point is kept only if no left-out feature breaks the conditions. Points are written by the tasks that solve them; the
driver holds the features, scales and coefficients of the active set, never a vector over all features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ridgeline.operators.anchored import ANCHORED_SCHEMA, FLUSH_BYTES, Anchored, anchored_products, read_anchored
from ridgeline.operators.design import Design, cache_packed, design
from ridgeline.operators.moments import _typed
from ridgeline.plans.descent import PathConfig, lambda_grid, sweep
from ridgeline.plans.journal import Journal

SPARSE_PATH_SCHEMA = (
    "fold int, cell int, alpha double, lambda_idx int, lambda double, intercept double, width int, "
    "indices array<int>, weights array<double>, beta array<double>, passes int, converged boolean, n bigint"
)
CANDIDATE_SCHEMA = f"number int, round int, {SPARSE_PATH_SCHEMA}"
SCALE_SCHEMA = (
    "held int, chunk int, start int, mean array<double>, std array<double>, xy array<double>, raw_xy array<double>, "
    "top double, raw_top double"
)
ACTIVE_SCHEMA = "fold int, n double, anchors array<int>, slots array<int>, anchor_mean array<double>, mean array<double>, c array<double>"
CHUNK = 512  # slots per row of the product tables
LOOK_AHEAD = 5  # request features that would pass the threshold this many grid steps later
FIRST_WINDOW = 16  # points solved ahead at first; twice as many after a round without refusals, half as many after others
STRONGEST = 64  # features of one chunk that a point may ask for at once; more come in the next rounds
WINDOW_CELLS = 2**20  # coefficients of candidate points that a check sends to its tasks: 8 MB


@dataclass
class Progress:
    """Where one path stands: the next grid index and the current nonzero coefficients."""

    index: int = 0
    features: list[int] = field(default_factory=list)
    beta: list[float] = field(default_factory=list)


@dataclass
class Training:
    """Scale of one training set: the label's, the tops of the grids, and those of active features."""

    n: float
    label_mean: float
    label_std: float
    top: dict[bool, float]  # by fit_intercept
    scales: dict[int, tuple[float, float, float, float]] = field(default_factory=dict)  # feature: mean, std, xy, raw xy

    def active(self, features: Sequence[int]) -> np.ndarray:
        return np.array([self.scales[f] for f in features]).reshape(-1, 4).T


def lazy_path(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    alphas: Sequence[float] = (0.01,),
    *,
    fold: Column | str | None = None,
    num_folds: int = 0,
    shared_lambdas: bool = False,
    handle_invalid: str = "error",
    journal: str | None = None,
    **options,
) -> DataFrame:
    """Elastic-net paths with sparse weights (``indices, weights, width``), one per alpha.

    With ``fold`` there is also one per (held-out fold, alpha); fold -1 trains on all rows. ``shared_lambdas`` uses
    the grid of all rows in every fold. With ``journal``, a folder that all executors share, a fit that was stopped
    goes on from its last finished round when it is started again with the same input and options.
    """
    configs = [PathConfig(alpha=float(a), **options) for a in alphas]
    if fold is None:
        num_folds = 0
    elif num_folds < 2:
        raise ValueError("num_folds must be at least 2 when a fold column is given")
    frame = design(df, label, features, fold, handle_invalid, num_folds or None)
    return lazy_cells(frame, configs, num_folds, shared_lambdas, journal)


def lazy_cells(
    frame: Design, configs: Sequence[PathConfig], num_folds: int = 0, shared_lambdas: bool = False, journal: str | None = None
) -> DataFrame:
    """One sparse path per training set and configuration; all of them share the products of each fold."""
    if any(c.entry != "full" for c in configs):
        raise ValueError("the lazy path always checks every feature before it keeps a point")
    cells = [(held, i, config) for held in range(-1, num_folds) for i, config in enumerate(configs)]
    fit = _Fit(frame, cells, shared_lambdas, Journal(frame.rows.sparkSession, journal, "lazy-path"))
    try:
        while fit.open:
            fit.one_round()
    finally:
        fit.close()
    return fit.points()


class _Fit:
    """Rounds of one fit; everything that outlives a round is in the journal."""

    def __init__(self, frame: Design, cells: list[tuple[int, int, PathConfig]], shared_lambdas: bool, journal: Journal):
        self.frame, self.cells, self.journal = frame, cells, journal
        self.spark = frame.rows.sparkSession
        self.packed: Design | None = None
        self.cached: list[DataFrame] = []
        self.label = journal.table("label-products", lambda: anchored_products(self.rows(), [0], CHUNK), ANCHORED_SCHEMA)
        self.training, self.width = label_trainings(self.label, sorted({held for held, _, _ in cells}))
        self.scales = journal.table("scales", lambda: training_scales(self.label, self.training), SCALE_SCHEMA)
        for row in self.scales.groupBy("held").agg(F.max("top").alias("top"), F.max("raw_top").alias("raw_top")).collect():
            self.training[row["held"]].top = {True: row["top"], False: row["raw_top"]}
        grid = self.training[-1] if shared_lambdas else None
        self.lambdas = []
        for held, _, config in cells:
            own = self.training[held]
            constant = own.label_std == 0.0
            self.lambdas.append(None if constant else lambda_grid((grid or own).top[config.fit_intercept], config))
        self.progress = [Progress() for _ in cells]
        self.parts: list[list[int]] = []  # features whose products the tables 1, 2, ... hold
        self.kept: list[tuple[int, int, int, int]] = []  # round, cell, first and last index
        self.round, self.window = 0, FIRST_WINDOW
        self.settings = [[held, i, asdict(config)] for held, i, config in cells] + [shared_lambdas, self.width]
        self._resume()

    def _resume(self) -> None:
        """Goes on from the last finished round, if there is one."""
        if found := self.journal.last(self.settings):
            self.round, state = found
            self.progress = [Progress(*p) for p in state["progress"]]
            self.parts, self.window = state["parts"], state["window"]
            self.kept = [tuple(k) for k in state["kept"]]
            self._learn(self.features)

    def _learn(self, features: Sequence[int]) -> None:
        learn_scales(self.scales, self.training, features)

    @property
    def open(self) -> list[int]:
        return [i for i, p in enumerate(self.progress) if p.index < self.cells[i][2].num_lambdas]

    @property
    def features(self) -> list[int]:
        return [f for part in self.parts for f in part]

    def rows(self) -> Design:
        """The input as cached blocks, packed when a job first needs it."""
        if self.packed is None:
            self.packed, self.cached = cache_packed(self.frame)
        return self.packed

    def close(self) -> None:
        for table in self.cached:
            table.unpersist()

    def one_round(self) -> None:
        self.round += 1
        features = sorted(self.features)
        at_once = max(1, min(self.window, WINDOW_CELLS // max(1, len(self.open) * len(features))))
        solved = self._solve(features, at_once)
        violated, wanted = self._check(features, solved)
        for number in self.open:
            own = [r for r in solved if r["number"] == number]
            stop = violated.get(number, own[-1]["lambda_idx"] + 1)
            if stop > own[0]["lambda_idx"]:
                self.kept.append((self.round, number, own[0]["lambda_idx"], stop - 1))
            last = own[min(stop - own[0]["lambda_idx"], len(own) - 1)]  # warm start, of the refused point itself if there is one
            self.progress[number] = Progress(stop, list(last["indices"]), list(last["beta"]))
        self.window = max(8, self.window // 2) if violated else 2 * self.window
        if wanted:
            self._grow(sorted(wanted))
        state = {
            "settings": self.settings,
            "progress": [[p.index, p.features, p.beta] for p in self.progress],
            "parts": self.parts,
            "window": self.window,
            "kept": self.kept,
        }
        self.journal.save(self.round, state)

    def _grow(self, fresh: list[int]) -> None:
        """Products of new features, so many at a time that a task's partial stays within its budget."""
        at_once = max(1, FLUSH_BYTES // (16 * (self.width + 1)))
        self._learn(fresh)
        for first in range(0, len(fresh), at_once):
            part = fresh[first : first + at_once]
            self.parts.append(part)
            make = anchored_products(self.rows(), [f + 1 for f in part], CHUNK)
            products = self.journal.table(self._name("products", len(self.parts)), lambda: make, ANCHORED_SCHEMA)
            # a pair of features is stored with the part that came later
            known = np.sort(np.array([f + 1 for f in self.features], dtype=int))
            self.journal.table(self._name("active", len(self.parts)), lambda: _active_products(products, part, known), ACTIVE_SCHEMA)

    def _name(self, kind: str, number: int) -> str:
        """A table of a part; other features make another name, should a repeated round choose others."""
        return f"{kind}-{number}-{zlib.crc32(repr(self.parts[number - 1]).encode()):08x}"

    def _names(self, kind: str) -> list[str]:
        return [self._name(kind, number) for number in range(1, len(self.parts) + 1)]

    def _solve(self, features: list[int], at_once: int) -> list:
        """Candidate points of all open paths, written by their tasks; the driver reads nonzero coefficients."""
        numbers, place = self.open, {f: i for i, f in enumerate(features)}
        todo = {}
        for number in numbers:
            held, cell, config = self.cells[number]
            own = self.training[held]
            todo[number] = (held, cell, config, own.n, own.label_mean, own.label_std, own.active(features), self.lambdas[number], self.progress[number])
        width, turn = self.width, self.round

        def solve(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = keys[0].as_py()
            held, cell, config, n, label_mean, label_std, (mean, std, xy, raw_xy), lambdas, start = todo[number]
            products = np.zeros((len(features), len(features)))
            for batch in batches:
                for row in _active_rows(batch):
                    anchors = np.array([place[f] for f in row["anchors"]])
                    slots = np.array([place[s - 1] for s in row["slots"]])
                    shift, across = row["anchor_mean"] - mean[anchors], row["mean"] - mean[slots]
                    block = row["c"].reshape(len(anchors), len(slots)) + row["n"] * np.outer(shift, across)
                    # pairs of features of one part are there twice: the other entries are added up by symmetry
                    products[np.ix_(anchors, slots)] += block
                    other = ~np.isin(slots, anchors)
                    products[np.ix_(slots[other], anchors)] += block[:, other].T
            if not config.fit_intercept:
                products, xy = products + n * np.outer(mean, mean), raw_xy
            inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
            gram = products * inverse[:, None] * inverse / n
            beta = np.zeros(len(features))
            beta[[place[f] for f in start.features]] = start.beta
            rows = []
            for index in range(start.index, min(start.index + at_once, config.num_lambdas) if lambdas is not None else config.num_lambdas):
                passes, converged, lam = 0, True, None
                if lambdas is not None:
                    lam = float(lambdas[index])
                    passes, converged = _descend(beta, xy, gram, lam, config)
                used = np.flatnonzero(beta)
                slopes = beta[used] * label_std * inverse[used]
                intercept = float(label_mean - slopes @ mean[used]) if config.fit_intercept or lambdas is None else 0.0
                rows.append(
                    (number, turn, held, cell, config.alpha, index, lam, intercept, width, [features[i] for i in used], slopes.tolist(), beta[used].tolist(), passes, bool(converged), int(n))
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _CANDIDATE.types)], schema=_CANDIDATE)

        def candidates() -> DataFrame:
            active = self.journal.tables(self._names("active"), ACTIVE_SCHEMA)
            wanted = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(self.cells[i][0]).alias("held")) for i in numbers])
            spread = active.withColumn("of", F.explode(wanted)).where("fold <> of.held").withColumn("number", F.col("of.number")).drop("of")
            # one record without products for each path, so that paths without active features are solved too
            named = self.spark.range(1).select(F.explode(F.array(*map(F.lit, numbers))).alias("number"))
            spread = spread.unionByName(named, allowMissingColumns=True).repartition(len(numbers), "number")
            return spread.groupBy("number").applyInArrow(_typed(solve), CANDIDATE_SCHEMA)

        # a table of a round whose state was not saved before the driver was lost is as good as a new one
        points = self.journal.table(f"points-{self.round}", candidates, CANDIDATE_SCHEMA)
        return sorted(points.select("number", "lambda_idx", "lambda", "indices", "beta").collect(), key=lambda r: r[:2])

    def _check(self, features: list[int], solved: list) -> tuple[dict[int, int], set[int]]:
        """First refused index of each path, and the features that are to enter for it."""
        points = [r for r in solved if r["lambda"] is not None]
        if not points:
            return {}, set()
        place = {f: i for i, f in enumerate(features)}
        held = np.array([self.cells[r["number"]][0] for r in points])
        centred = np.array([self.cells[r["number"]][2].fit_intercept for r in points])
        alpha = [self.cells[r["number"]][2].alpha for r in points]
        bound = np.array([r["lambda"] * a for r, a in zip(points, alpha)])
        ahead = [self.lambdas[r["number"]][min(r["lambda_idx"] + LOOK_AHEAD, len(self.lambdas[r["number"]]) - 1)] * a for r, a in zip(points, alpha)]
        slopes = np.zeros((len(points), len(features)))  # on the scale of centred features
        for i, r in enumerate(points):
            _, std, _, _ = self.training[int(held[i])].active(r["indices"])
            slopes[i, [place[f] for f in r["indices"]]] = np.array(r["beta"]) / std
        means = {h: own.active(features)[0] for h, own in self.training.items()}
        raw = np.array([0.0 if c else slopes[i] @ means[h] for i, (h, c) in enumerate(zip(held.tolist(), centred))])
        counts = np.array([self.training[int(h)].n for h in held])
        parts = list(zip(self._names("products"), self.parts))
        sent = self.spark.sparkContext.broadcast((slopes, means))
        sums = None
        for name, part in parts:
            own = _fitted_sums(self.journal.tables([name], ANCHORED_SCHEMA), sent, held, [place[f] for f in part])
            sums = own if sums is None else sums.unionByName(own)
        scales = self.scales.select("chunk", "held", "start", "mean", "std", "xy", "raw_xy")
        rows = scales if sums is None else scales.unionByName(sums, allowMissingColumns=True)
        active = np.array([f + 1 for f in features], dtype=int)

        def check(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scale, fitted, shift = {}, None, 0.0
            for batch in batches:
                for row in _check_rows(batch):
                    if row["held"] is not None:
                        scale[row["held"]] = row
                    else:
                        fitted = row["fitted"] if fitted is None else fitted + row["fitted"]
                        shift = shift + row["shift"]
            start, slots = next((r["start"], len(r["mean"])) for r in scale.values())
            fitted = np.zeros((len(points), slots)) if fitted is None else fitted.reshape(len(points), slots)
            left_out = np.ones(slots, dtype=bool)
            left_out[active[(active >= start) & (active < start + slots)] - start] = False
            if start == 0:
                left_out[0] = False  # the label
            out = []
            for i in range(len(points)):
                row = scale[int(held[i])]
                total = fitted[i] + (counts[i] * raw[i] - (shift[i] if np.ndim(shift) else 0.0)) * row["mean"]
                inverse = np.divide(1.0, row["std"], out=np.zeros(slots), where=row["std"] > 0)
                slope = np.where(left_out, np.abs(row["xy" if centred[i] else "raw_xy"] - total * inverse / counts[i]), 0.0)
                if (slope > bound[i]).any():
                    near = np.flatnonzero(slope > ahead[i])
                    near = near[np.argsort(-slope[near], kind="stable")[:STRONGEST]]
                    out.append((i, (near + start - 1).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([f for _, f in out], pa.list_(pa.int32()))], ["point", "features"])

        violated: dict[int, int] = {}
        wanted: dict[int, set[int]] = {}
        refused = rows.groupBy("chunk").applyInArrow(_typed(check), "point int, features array<int>")
        first = F.col("point")
        # of each path only the first refused point counts
        owner = F.element_at(F.array(*[F.lit(r["number"]) for r in points]), first + 1)
        refused = refused.withColumn("number", owner).groupBy("number", "point").agg(F.flatten(F.collect_list("features")).alias("features"))
        for r in refused.groupBy("number").agg(F.min_by(F.struct("point", "features"), "point").alias("first")).collect():
            point = points[r["first"]["point"]]
            violated[r["number"]] = point["lambda_idx"]
            wanted[r["number"]] = set(r["first"]["features"])
        return violated, set().union(*wanted.values())

    def points(self) -> DataFrame:
        """All kept points, read from where their tasks wrote them."""
        rounds = sorted({r for r, *_ in self.kept})
        candidates = self.journal.tables([f"points-{r}" for r in rounds], CANDIDATE_SCHEMA)
        kept = self.spark.createDataFrame(self.kept, "round int, number int, first int, last int")
        names = [f.split()[0] for f in SPARSE_PATH_SCHEMA.split(", ")]
        return candidates.join(kept, ["round", "number"]).where(F.col("lambda_idx").between(F.col("first"), F.col("last"))).select(*names)


def _descend(beta: np.ndarray, xy: np.ndarray, gram: np.ndarray, lam: float, config: PathConfig) -> tuple[int, bool]:
    """Coordinate passes on the active features; changes ``beta``."""
    gamma, ridge = lam * config.alpha, 1.0 + lam * (1.0 - config.alpha)
    g = xy - beta @ gram
    passes, converged = 0, len(beta) == 0
    while passes < config.max_iter and not converged:
        change = sweep(g, beta, gram, gamma, ridge)
        passes += 1
        converged = change <= config.tol * np.abs(beta).sum()
    return passes, converged


def label_trainings(label: DataFrame, helds: Sequence[int]) -> tuple[dict[int, Training], int]:
    """Label statistics of every training set, from one number per fold each, and the number of features."""
    first = [F.col(k)[0].alias(k) for k in ("mean", "low", "high", "square")]
    folds = label.where("chunk = 0").select("fold", "n", *first).collect()
    width = label.agg(F.max(F.col("start") + F.size("mean")).alias("width")).first()["width"]
    out = {}
    for held in helds:
        own = [r for r in folds if r["fold"] != held]
        if not own:
            raise ValueError("no rows to train on" + ("" if held < 0 else f" when fold {held} is held out"))
        n = sum(r["n"] for r in own)
        mean = sum(r["n"] * r["mean"] for r in own) / n
        square = sum(r["square"] + r["n"] * (r["mean"] - mean) ** 2 for r in own)
        varies = min(r["low"] for r in own) < max(r["high"] for r in own)
        out[held] = Training(n, mean, float(np.sqrt(square / (n - 1))) if varies and n > 1 else 0.0, {})
    return out, (width or 1) - 1


def learn_scales(scales: DataFrame, training: dict[int, Training], features: Sequence[int]) -> None:
    """Scales of new active features, a few numbers for each, from the chunks they lie in."""
    slots = np.sort(np.array([f + 1 for f in features], dtype=int))
    if not len(slots):
        return

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                inside = slots[(slots >= row["start"]) & (slots < row["start"] + len(row["mean"]))] - row["start"]
                rows += [(row["held"], int(row["start"] + s - 1), *(row[k][s] for k in ("mean", "std", "xy", "raw_xy"))) for s in inside]
            if rows:
                kinds = (pa.int32(), pa.int32(), *[pa.float64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["held", "feature", "mean", "std", "xy", "raw_xy"])

    chunks = sorted(set((slots // CHUNK).tolist()))
    found = scales.where(F.col("chunk").isin(chunks)).mapInArrow(work, "held int, feature int, mean double, std double, xy double, raw_xy double")
    for r in found.collect():
        training[r["held"]].scales[r["feature"]] = (r["mean"], r["std"], r["xy"], r["raw_xy"])


def training_scales(label: DataFrame, training: dict[int, Training]) -> DataFrame:
    """Mean, deviation and product with the label of every slot, for each training set; one task per chunk."""
    label_scale = {h: (own.n, own.label_mean, own.label_std) for h, own in training.items()}

    def work(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds: dict[int, Anchored] = {}
        for batch in batches:
            for fold, (_, item) in zip(batch.column("fold").to_pylist(), read_anchored(batch)):
                folds[fold] = item
        rows = []
        for held, (n, label_mean, label_std) in label_scale.items():
            total = None
            for fold, item in sorted(folds.items()):
                if fold != held:
                    total = item if total is None else total.merge(item)
            std = total.std
            inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0) * (1.0 / label_std if label_std else 0.0)
            xy, raw_xy = total.c[0] * inverse / n, (total.c[0] + n * label_mean * total.mean) * inverse / n
            if total.start == 0:
                xy[0] = raw_xy[0] = 0.0  # the label with itself
            rows.append((held, keys[0].as_py(), total.start, *(v.tolist() for v in (total.mean, std, xy, raw_xy)), float(np.abs(xy).max()), float(np.abs(raw_xy).max())))
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 4, pa.float64(), pa.float64())
        names = [f.split()[0] for f in SCALE_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return label.groupBy("chunk").applyInArrow(_typed(work), SCALE_SCHEMA)


def _active_products(products: DataFrame, anchors: list[int], known: np.ndarray) -> DataFrame:
    """Of the products with ``anchors``, those of slots that are active themselves; narrow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            for i, item in read_anchored(batch):
                inside = known[(known >= item.start) & (known < item.start + len(item.mean))]
                if len(inside):
                    at = inside - item.start
                    lists = [(anchors, pa.int32()), (inside, pa.int32()), (item.anchor_mean, pa.float64()), (item.mean[at], pa.float64()), (np.ravel(item.c[:, at]), pa.float64())]
                    arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in lists]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([folds[i]], pa.int32()), pa.array([item.n], pa.float64()), *arrays], ["fold", "n", "anchors", "slots", "anchor_mean", "mean", "c"]
                    )

    return products.mapInArrow(work, ACTIVE_SCHEMA)


def _active_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i, n in enumerate(batch.column("n").to_pylist()):
        if n is not None:
            row = {k: batch.column(k)[i].values.to_numpy() for k in ("anchors", "slots", "anchor_mean", "mean", "c")}
            yield row | {"n": n}


def _fitted_sums(products: DataFrame, sent, held: np.ndarray, places: list[int]) -> DataFrame:
    """For each chunk and task ``fitted`` (points by slots) and ``shift`` (points): their sums over folds and parts give

    ``sum (x_j - m_j) (x'v)`` of every slot j and point v, as ``fitted - shift * m_j``, with the training mean m_j.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes, means = sent.value
        own = slopes[:, places]
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            folds, chunks = batch.column("fold").to_pylist(), batch.column("chunk").to_pylist()
            for i, item in read_anchored(batch):
                use = np.where(held != folds[i], 1.0, 0.0)[:, None] * own
                off = np.zeros(len(held))
                for k in np.unique(held).tolist():
                    at = held == k
                    off[at] = use[at] @ (item.anchor_mean - means[k][places]) * item.n
                fitted = use @ item.c + np.outer(off, item.mean)
                total = totals.setdefault(chunks[i], [np.zeros_like(fitted), np.zeros(len(held))])
                total[0] += fitted
                total[1] += off
            if sum(8 * t[0].size for t in totals.values()) > FLUSH_BYTES:
                yield from _sum_batches(totals)
                totals = {}
        yield from _sum_batches(totals)

    return products.mapInArrow(work, "chunk int, fitted array<double>, shift array<double>")


def _sum_batches(totals: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for chunk, sums in totals.items():
        arrays = [pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(np.ravel(v))) for v in sums]
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *arrays], ["chunk", "fitted", "shift"])


def _check_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    held = batch.column("held").to_pylist()
    start = batch.column("start").to_pylist()
    for i, h in enumerate(held):
        names = ("fitted", "shift") if h is None else ("mean", "std", "xy", "raw_xy")
        yield {"held": h, "start": start[i]} | {k: np.array(batch.column(k)[i].values.to_numpy(), dtype=float) for k in names}


def densify(path: DataFrame) -> DataFrame:
    """Expand sparse weights and betas to full arrays."""

    @F.pandas_udf("array<double>")
    def full(width: pd.Series, indices: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([spread_out(*row) for row in zip(width, indices, values)], dtype=object)

    columns = {name: full("width", "indices", name) for name in ("weights", "beta")}
    return path.withColumns(columns).drop("indices", "width")


def spread_out(width: int, indices: Sequence[int], values: Sequence[float]) -> np.ndarray:
    out = np.zeros(width)
    out[np.asarray(indices, dtype=int)] = values
    return out


_DOUBLES, _INTS = pa.list_(pa.float64()), pa.list_(pa.int32())
_CANDIDATE = pa.schema(
    [
        ("number", pa.int32()),
        ("round", pa.int32()),
        ("fold", pa.int32()),
        ("cell", pa.int32()),
        ("alpha", pa.float64()),
        ("lambda_idx", pa.int32()),
        ("lambda", pa.float64()),
        ("intercept", pa.float64()),
        ("width", pa.int32()),
        ("indices", _INTS),
        ("weights", _DOUBLES),
        ("beta", _DOUBLES),
        ("passes", pa.int32()),
        ("converged", pa.bool_()),
        ("n", pa.int64()),
    ]
)
