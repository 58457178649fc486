"""Logistic paths for wide input: weighted products of active features only, and the gradient of all others.

A reweighting round needs, for each path, products of the active features (their number squared) and one gradient
number for every feature, so a task holds ``|active|^2 + p`` numbers for a path instead of ``p^2``. One job makes a
round of all paths:

* map tasks add up products and gradients of their rows;
* gradients meet the scales of their features chunk by chunk, and only features that break the optimality conditions,
  or may do so at the next penalty, go on;
* one task per path takes its step, or keeps the point that the gradient has just confirmed and steps on from it.

A point is kept only if the gradient at exactly that point leaves every other feature at zero. Kept points are written
by those tasks; the driver holds the coefficients of active features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ridgeline.operators.anchored import ANCHORED_SCHEMA, anchored_products
from ridgeline.operators.design import Design, cache_packed
from ridgeline.operators.moments import _typed
from ridgeline.operators.scatter import BLOCK_CELLS, row_blocks
from ridgeline.operators.weighted import SALTS, weights_and_response
from ridgeline.plans.journal import Journal
from ridgeline.plans.lazy import CHUNK, SCALE_SCHEMA, STRONGEST, Training, label_trainings, learn_scales, training_scales

SPARSE_LOGISTIC_SCHEMA = (
    "fold int, cell int, alpha double, lambda_idx int, lambda double, intercept double, width int, indices array<int>, "
    "weights array<double>, beta0 double, beta array<double>, rounds int, converged boolean, n bigint"
)
REPLY_SCHEMA = f"kind string, number int, pending boolean, active array<int>, {SPARSE_LOGISTIC_SCHEMA}"
PARTIAL_SCHEMA = "number int, block int, salt int, data array<double>"
MERGED_SCHEMA = "number int, block int, data array<double>, features array<int>, violated boolean"


@dataclass
class State:
    """Where one path stands. ``pending``: the coefficients are to be confirmed as the point of ``index``."""

    index: int = -1  # the null model comes before the first penalty
    rounds: int = 0
    pending: bool = True
    converged: bool = True
    beta0: float = 0.0
    active: list[int] = field(default_factory=list)
    beta: list[float] = field(default_factory=list)


def active_logistic_cells(
    frame: Design, configs: Sequence, num_folds: int, state_cells: int, journal: str | None = None
) -> DataFrame:
    """Sparse logistic paths, one for each training set and configuration."""
    cells = [(held, i, config) for held in range(-1, num_folds) for i, config in enumerate(configs)]
    fit = _Fit(frame, cells, state_cells, Journal(frame.rows.sparkSession, journal, "logistic-path"))
    try:
        while fit.open:
            fit.one_round()
    finally:
        fit.close()
    return fit.points()


class _Fit:
    """Rounds of one fit; everything that outlives a round is in the journal."""

    def __init__(self, frame: Design, cells: list[tuple], state_cells: int, journal: Journal):
        self.frame, self.cells, self.state_cells, self.journal = frame, cells, state_cells, journal
        self.spark = frame.rows.sparkSession
        self.packed: Design | None = None
        self.cached: list[DataFrame] = []
        label = journal.table("label-products", lambda: anchored_products(self.rows(), [0], CHUNK), ANCHORED_SCHEMA)
        self.training, self.width = label_trainings(label, sorted({held for held, _, _ in cells}))
        self.scales = journal.table("scales", lambda: training_scales(label, self.training), SCALE_SCHEMA)
        for row in self.scales.groupBy("held").agg(F.max("top").alias("top")).collect():
            own = self.training[row["held"]]
            own.top = {True: row["top"] * own.label_std}  # the label itself is not scaled here
        self.lambdas, self.states = [], []
        for held, _, config in cells:
            own = self.training[held]
            constant = own.label_std == 0.0
            share = min(max(own.label_mean, 1e-5), 1.0 - 1e-5) if constant else own.label_mean
            moving = config.fit_intercept and not config.freeze_intercept
            self.lambdas.append(None if constant else config.lambdas(own.top[True]))
            start = State(beta0=float(np.log(share / (1.0 - share))) if moving else 0.0)
            start.index = config.num_lambdas if constant else -1
            self.states.append(start)
        self.round = 0
        self.settings = [[held, i, asdict(config)] for held, i, config in cells] + [self.width]
        if found := journal.last(self.settings):
            self.round, state = found
            self.states = [State(*s) for s in state["states"]]
            self._learn([f for s in self.states for f in s.active])

    @property
    def open(self) -> list[int]:
        return [i for i, s in enumerate(self.states) if s.index < self.cells[i][2].num_lambdas]

    def rows(self) -> Design:
        if self.packed is None:
            self.packed, self.cached = cache_packed(self.frame)
        return self.packed

    def close(self) -> None:
        for table in self.cached:
            table.unpersist()

    def _learn(self, features: Sequence[int]) -> None:
        fresh = sorted(set(features) - set(self.training[-1].scales))
        learn_scales(self.scales, self.training, fresh)

    def one_round(self) -> None:
        """One step of every open path; paths whose sums would not fit into a task together take turns."""
        self.round += 1
        waiting = self.open
        groups: list[list[int]] = [[]]
        held = 0
        for number in waiting:
            cost = (len(self.states[number].active) + 2) ** 2 + self.width
            if groups[-1] and held + cost > self.state_cells:
                groups.append([])
                held = 0
            groups[-1].append(number)
            held += cost
        for turn, numbers in enumerate(groups):
            name = f"replies-{self.round}-{turn}"
            replies = self.journal.table(name, lambda: self._replies(numbers), REPLY_SCHEMA)
            names = ("number", "lambda_idx", "rounds", "pending", "converged", "beta0", "active", "beta")
            for r in replies.where("kind = 'state'").select(*names).collect():
                self.states[r["number"]] = State(r["lambda_idx"], r["rounds"], r["pending"], r["converged"], r["beta0"], list(r["active"]), list(r["beta"]))
        self._learn([f for s in self.states for f in s.active])
        states = [[s.index, s.rounds, s.pending, s.converged, s.beta0, s.active, s.beta] for s in self.states]
        self.journal.save(self.round, {"settings": self.settings, "states": states, "groups": len(groups)})

    def _replies(self, numbers: list[int]) -> DataFrame:
        todo = {}
        for number in numbers:
            held, cell, config = self.cells[number]
            own, state = self.training[held], self.states[number]
            mean, std, _, _ = own.active(state.active)
            todo[number] = _Task(held, cell, config, own.n, self.lambdas[number], state, mean if config.fit_intercept else np.zeros(len(mean)), std, self.width)
        sent = self.spark.sparkContext.broadcast(todo)  # coefficients and scales of active features
        frame = self.rows()
        partials = frame.rows.mapInArrow(_partial_sums(sent, frame.columns), PARTIAL_SCHEMA)
        if frame.rows.rdd.getNumPartitions() > 8 * SALTS:
            partials = partials.groupBy("number", "block", "salt").applyInArrow(_typed(_added), PARTIAL_SCHEMA)
        owner = [F.struct(F.lit(i).alias("number"), F.lit(t.held).alias("held")) for i, t in todo.items() if t.state.pending]
        if owner:
            scales = self.scales.withColumn("of", F.explode(F.array(*owner))).where("held = of.held")
            scales = scales.select(F.col("of.number").alias("number"), (-1 - F.col("chunk")).alias("block"), "start", "mean", "std")
            partials = partials.unionByName(scales, allowMissingColumns=True)
        else:
            partials = partials.withColumns({"start": F.lit(None).cast("int"), "mean": F.lit(None).cast("array<double>"), "std": F.lit(None).cast("array<double>")})
        merged = partials.groupBy("number", "block").applyInArrow(_typed(_merged(sent)), MERGED_SCHEMA)
        return merged.groupBy("number").applyInArrow(_typed(_advanced(sent)), REPLY_SCHEMA)

    def points(self) -> DataFrame:
        """All kept points, read from where their tasks wrote them."""
        names = [f.split()[0] for f in SPARSE_LOGISTIC_SCHEMA.split(", ")]
        written = []
        for number in range(1, self.round + 1):
            turn = 0
            while self.journal.has(f"replies-{number}-{turn}"):
                written.append(f"replies-{number}-{turn}")
                turn += 1
        points = self.journal.tables(written, REPLY_SCHEMA).where("kind = 'point'").select(*names)
        flat = []
        for i, (held, cell, config) in enumerate(self.cells):
            if self.lambdas[i] is None:  # one class only: the constant model at every grid entry
                beta0, n = self.states[i].beta0, int(self.training[held].n)
                intercept = beta0 if config.fit_intercept else 0.0
                flat += [(held, cell, config.alpha, k, None, intercept, self.width, [], [], beta0, [], 0, True, n) for k in range(config.num_lambdas)]
        return points.unionByName(self.spark.createDataFrame(flat, SPARSE_LOGISTIC_SCHEMA)) if flat else points


@dataclass(frozen=True)
class _Task:
    """What the tasks of a round know of one path."""

    held: int
    cell: int
    config: object
    n: float
    lambdas: np.ndarray
    state: State
    mean: np.ndarray
    std: np.ndarray
    width: int


def _partial_sums(sent, columns: list[str]):
    """Weighted products of active features, and of pending paths the gradient of all features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: dict[int, _Task] = sent.value
        products = {k: np.zeros((len(t.state.active) + 1, len(t.state.active) + 2)) for k, t in todo.items()}
        pending = [k for k, t in todo.items() if t.state.pending]
        slopes = rest = None
        for batch in batches:
            for fold, rows in row_blocks(batch, columns):
                label, residuals = rows[:, 0], []
                for number, task in todo.items():
                    state = task.state
                    z = np.ones((len(rows), len(state.active) + 1))
                    z[:, 1:] = (rows[:, np.array(state.active, dtype=int) + 1] - task.mean) / task.std
                    margin = state.beta0 + z[:, 1:] @ np.array(state.beta)
                    weight, response = weights_and_response(label, margin)
                    if task.held >= 0:
                        kept = fold != task.held
                        weight, response = weight * kept, response * kept
                    total = products[number]
                    total[:, :-1] += z.T @ (z * weight[:, None])
                    total[:, -1] += z.T @ response
                    if state.pending:
                        residuals.append(response - weight * margin)
                if slopes is None:
                    slopes, rest = np.zeros((len(pending), rows.shape[1])), np.zeros(len(pending))
                if pending:
                    together = np.array(residuals)
                    slopes += together @ rows
                    rest += together.sum(axis=1)
        if slopes is None:
            return
        context = TaskContext.get()
        salt = context.partitionId() % SALTS if context else 0
        for number, total in products.items():
            step = max(1, BLOCK_CELLS // total.shape[1])
            for block, start in enumerate(range(0, len(total), step)):
                yield _partial(number, block, salt, np.ravel(total[start : start + step]))
        for i, number in enumerate(pending):
            for chunk, start in enumerate(range(0, slopes.shape[1], CHUNK)):
                yield _partial(number, -1 - chunk, salt, np.append(slopes[i, start : start + CHUNK], rest[i]))

    return work


def _partial(number: int, block: int, salt: int, data: np.ndarray) -> pa.RecordBatch:
    values = pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))
    return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (number, block, salt)), values], ["number", "block", "salt", "data"])


def _sum(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray | None, dict | None]:
    """The sum of all data, and the scales if they came along."""
    total, scale = None, None
    for batch in batches:
        scaled = "mean" in batch.schema.names
        for i in range(batch.num_rows):
            if batch.column("data")[i].is_valid:
                data = batch.column("data")[i].values.to_numpy()
                total = np.array(data) if total is None else total + data
            elif scaled:
                scale = {k: np.array(batch.column(k)[i].values.to_numpy()) for k in ("mean", "std")} | {"start": batch.column("start")[i].as_py()}
    return total, scale


def _added(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _partial(*(k.as_py() for k in keys), _sum(batches)[0])


def _merged(sent):
    """Sums of a block; of a chunk of the gradient only the features that may not stay at zero."""

    def work(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = keys[0].as_py(), keys[1].as_py()
        total, scale = _sum(batches)
        features, violated = [], False
        if block < 0:
            task: _Task = sent.value[number]
            alpha, index = task.config.alpha, task.state.index
            gradient = total[:-1] - (total[-1] * scale["mean"] if task.config.fit_intercept else 0.0)
            slope = np.abs(np.divide(gradient, scale["std"], out=np.zeros(len(gradient)), where=scale["std"] > 0)) / task.n
            inside = np.array(task.state.active, dtype=int) + 1 - scale["start"]
            slope[inside[(inside >= 0) & (inside < len(slope))]] = 0.0
            if scale["start"] == 0:
                slope[0] = 0.0  # the label
            bound = task.lambdas[index] * alpha if index >= 0 else np.inf
            violated = bool((slope > bound).any())
            if violated:
                least = bound
            elif index + 1 < len(task.lambdas):
                # a feature enters at the next penalty only if its slope grows by more than the step between the two
                last = task.lambdas[index] if index >= 0 else task.lambdas[0] ** 2 / task.lambdas[1] if len(task.lambdas) > 1 else task.lambdas[0]
                least = (2 * task.lambdas[index + 1] - last) * alpha
            else:
                least = np.inf
            near = np.flatnonzero(slope > max(least, 0.0))
            near = near[np.argsort(-slope[near], kind="stable")[:STRONGEST]]
            features, total = (near + scale["start"] - 1).tolist(), None
        data = pa.array([None if total is None else total.tolist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([block], pa.int32()), data, pa.array([features], pa.list_(pa.int32())), pa.array([violated])],
            ["number", "block", "data", "features", "violated"],
        )

    return work


def _advanced(sent):
    """The step of one path, and the point it keeps, if any."""

    def work(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ridgeline.plans.logistic import penalized_step, relative_change

        number = keys[0].as_py()
        task: _Task = sent.value[number]
        state, config = task.state, task.config
        bands, wanted, violated = {}, set(), False
        for batch in batches:
            data = batch.column("data")
            for i, (block, features, bad) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "features", "violated")))):
                if block >= 0:
                    bands[block] = data[i].values.to_numpy()
                elif bad and not violated:
                    wanted, violated = set(features), True  # what only may enter later can wait
                elif bad == violated:
                    wanted |= set(features)
        width = len(state.active) + 1
        joined = np.concatenate([bands[k] for k in sorted(bands)]).reshape(width, width + 1)
        rows = []
        index, beta0, beta = state.index, state.beta0, np.array(state.beta)
        rounds, pending, converged = state.rounds, state.pending, state.converged
        if pending and violated:
            pending, rounds = False, 0  # the same penalty again, with the features it lacked
        else:
            if pending:
                if index >= 0:
                    rows.append(_point(task, number))
                index, rounds, pending = index + 1, 0, False
            if index < config.num_lambdas:
                lam = float(task.lambdas[index])
                new0, new = penalized_step(joined[:, :width], joined[:, width], task.n, beta0, beta, lam, config)
                distance = relative_change(beta0, beta, new0, new, config)
                beta0, beta, rounds = new0, new, rounds + 1
                converged = distance <= config.tol
                # a path with features yet to come, or without any product so far, is not there yet
                pending = not wanted and (converged or rounds >= config.max_rounds)
        fresh = sorted(wanted - set(state.active))
        beta = np.append(beta, np.zeros(len(fresh))) + 0.0
        reply = dict.fromkeys(_REPLY.names)
        reply.update(
            kind="state", number=number, lambda_idx=index, rounds=rounds, pending=bool(pending), converged=bool(converged),
            beta0=float(beta0), active=[*state.active, *fresh], beta=beta.tolist(),
        )
        yield pa.RecordBatch.from_pylist([*rows, reply], schema=_REPLY)

    return work


def _point(task: _Task, number: int) -> dict:
    state, config = task.state, task.config
    beta = np.array(state.beta)
    used = np.flatnonzero(beta)
    weights = beta[used] / task.std[used]
    order = np.argsort(np.array(state.active, dtype=int)[used])
    reply = dict.fromkeys(_REPLY.names)
    reply.update(
        kind="point", number=number, fold=task.held, cell=task.cell, alpha=config.alpha, lambda_idx=state.index,
        intercept=float(state.beta0 - weights @ task.mean[used]) if config.fit_intercept else 0.0, width=task.width,
        indices=[state.active[i] for i in used[order]], weights=weights[order].tolist(), beta0=float(state.beta0),
        beta=beta[used][order].tolist(), rounds=state.rounds, converged=state.converged, n=int(task.n),
    )
    reply["lambda"] = float(task.lambdas[state.index])
    return reply


_DOUBLES, _INTS = pa.list_(pa.float64()), pa.list_(pa.int32())
_REPLY = pa.schema(
    [
        ("kind", pa.string()),
        ("number", pa.int32()),
        ("pending", pa.bool_()),
        ("active", _INTS),
        ("fold", pa.int32()),
        ("cell", pa.int32()),
        ("alpha", pa.float64()),
        ("lambda_idx", pa.int32()),
        ("lambda", pa.float64()),
        ("intercept", pa.float64()),
        ("width", pa.int32()),
        ("indices", _INTS),
        ("weights", _DOUBLES),
        ("beta0", pa.float64()),
        ("beta", _DOUBLES),
        ("rounds", pa.int32()),
        ("converged", pa.bool_()),
        ("n", pa.int64()),
    ]
)
