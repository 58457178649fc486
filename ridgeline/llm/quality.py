"""A quality classifier by co-training.

Two views of a document are learned apart: its text (byte pairs, word and line statistics), and the metadata of the
page (source, language, length). In each round both views judge all documents without label, and each is then fitted on
the labelled rows and on what the *other* view is sure about. Those pseudo-labels come from every document: a Newton
step adds up slopes and curvatures in the tasks that hold the documents' features, so no document is drawn or left out.
All pseudo-labels of a class together weigh at most as much as the labelled rows of that class, times ``trust``. Each
view is then calibrated on labelled rows that no view was fitted on, and the calibrated views are combined to one score.

Only labelled rows are bounded (``labelled`` rows, chosen by a hash of the id). Features are stored once; a step reads
them in one pass, and scoring is one narrow pass over all whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.llm.common import arrow_map, materialize, pack

PAIRS = 256
SURFACE = 14
SOURCES = 48
LANGS = 12
LENGTHS = 12


def text_view(text: str | None) -> np.ndarray:
    """Features of a whole text; zeros for a null or empty one."""
    out = np.zeros(PAIRS + SURFACE)
    raw = (text or "").encode()
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256) / len(data)
    if len(data) > 1:
        code = (data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761) >> np.uint32(24)
        out[:PAIRS] = np.sqrt(np.bincount(code, minlength=PAIRS) / (len(data) - 1))
    words = raw.split()
    lines = raw.split(b"\n")
    n = max(len(words), 1)
    same = sum(map(bytes.__eq__, words, words[1:]))
    out[PAIRS:] = [
        counts[65:91].sum(),
        counts[97:123].sum(),
        counts[48:58].sum(),
        counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum(),
        counts[128:].sum(),
        counts[32],
        counts[10] * 10,
        np.log1p(len(raw)) / 10,
        len(set(words)) / n,
        same / n,
        len(raw) / n / 20,
        len(set(lines)) / len(lines),
        np.log1p(max(map(len, lines))) / 10,
        sum(map(bytes.isupper, words)) / n,
    ]
    return out


def meta_view(source: str | None, lang: str | None, chars: int | None) -> np.ndarray:
    """Features of a page's metadata; null is a value like others."""
    out = np.zeros(SOURCES + LANGS + LENGTHS + 1)
    place = lambda value, size: zlib.crc32(repr(value).encode()) % size
    out[place(source, SOURCES)] = 1
    out[SOURCES + place(lang, LANGS)] = 1
    size = np.log1p(max(chars or 0, 0))
    out[SOURCES + LANGS + min(int(size), LENGTHS - 1)] = 1
    out[-1] = size / 10
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of a logistic model, the constant last, by Newton steps with a ridge on all but the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(steps):
        p = sigmoid(x @ w)
        before = w
        w = newton(w, x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x, ridge)
        if np.abs(w - before).max() < 1e-7:
            break
    return w


def newton(w: np.ndarray, slope: np.ndarray, curve: np.ndarray, ridge: float) -> np.ndarray:
    """A bounded step on a loss with a ridge on all weights but the constant."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-9
    move = np.linalg.solve(curve + np.diag(penalty), slope + penalty * w)
    return w - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Sums:
    """Slope and curvature of the logistic loss of one view over some rows of one class."""

    rows: float
    slope: np.ndarray
    curve: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Sums:
        x = np.hstack([x, np.ones((len(x), 1))])
        p = sigmoid(x @ w)
        return cls(float(len(x)), x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x)


def pseudo_sums(views: list[np.ndarray], teachers: list[np.ndarray], weights: list[np.ndarray], sure: float) -> dict[tuple[int, int], Sums]:
    """Sums by view and class over rows that the other view's teacher is sure about."""
    out = {}
    for i, x in enumerate(views):
        p = sigmoid(margin(views[1 - i], teachers[1 - i]))
        for value, chance in ((1, p), (0, 1 - p)):
            own = x[chance >= sure]
            out[i, value] = Sums.of(own, np.full(len(own), float(value)), weights[i])
    return out


# Sums over all rows without label, for teachers and weights of both views.
Pool = Callable[[list[np.ndarray], list[np.ndarray]], dict[tuple[int, int], Sums]]


@dataclass
class QualityModel:
    """Weights of both views, (slope, constant) that calibrate each, and the weights that combine them."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    calibration: list[np.ndarray] = field(default_factory=list)
    combined: np.ndarray | None = None
    prior: float = 1.0
    pseudo_labels: tuple[int, int] = (0, 0)  # given to the text view, and to the metadata view

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text score, metadata score and combined score."""
        if self.combined is None:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        logits = [margin(margin(x, w)[:, None], c) for x, w, c in zip((text, meta), (self.text, self.meta), self.calibration)]
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(margin(np.stack(logits, 1), self.combined))


def co_train(
    text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool: Pool, rounds: int, steps: int, ridge: float, trust: float
) -> QualityModel:
    """Fits a model on labelled rows (1 or 0) and the sums of ``pool``. One row of each labelled four calibrates."""
    if not len(label):
        return QualityModel()
    if len(np.unique(label)) < 2 or len(label) < 8:
        return QualityModel(prior=float(label.mean()))
    held = np.zeros(len(label), bool)
    for value in (0, 1):
        held[np.flatnonzero(label == value)[1::4]] = True
    if len(np.unique(label[held])) < 2:
        held[:] = False
    views = [text, meta]
    fitted = [(x[~held], label[~held].astype(float)) for x in views]
    weights = [fit_logistic(x, y, ridge) for x, y in fitted]
    given = [0, 0]
    for _ in range(rounds):
        teachers = [w.copy() for w in weights]
        for _ in range(steps):
            found = pool(teachers, weights)
            for i, (x, y) in enumerate(fitted):
                own = Sums.of(x, y, weights[i])
                slope, curve = own.slope, own.curve
                for value in (0, 1):
                    one = found[i, value]
                    share = min(1.0, trust * float((y == value).sum()) / max(one.rows, 1.0))
                    slope, curve = slope + share * one.slope, curve + share * one.curve
                weights[i] = newton(weights[i], slope, curve, ridge)
            given = [int(found[i, 0].rows + found[i, 1].rows) for i in range(2)]
    check = held if held.any() else np.ones(len(label), bool)
    truth = label[check].astype(float)
    calibration = [fit_logistic(margin(x[check], w)[:, None], truth, 0.1) for x, w in zip(views, weights)]
    logits = np.stack([margin(margin(x[check], w)[:, None], c) for x, w, c in zip(views, weights, calibration)], 1)
    combined = fit_logistic(logits, truth, 0.1)
    return QualityModel(weights[0], weights[1], calibration, combined, float(truth.mean()), tuple(given))


def _views(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    text = np.empty((len(columns[0]), PAIRS + SURFACE))
    for i, value in enumerate(columns[0]):
        text[i] = text_view(value.as_py())
    meta = np.array([meta_view(*row) for row in zip(*(c.to_pylist() for c in columns[1:]))])
    return text, meta


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    text, meta = _views(batch.columns[2:])
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.float32))) for x in (text, meta)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc", "label", "text", "meta"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    chars_col: str = "n_chars",
    label_col: str = "quality",
    labelled: int = 4000,
    rounds: int = 3,
    steps: int = 2,
    sure: float = 0.98,
    ridge: float = 0.05,
    trust: float = 1.0,
) -> QualityModel:
    """Fits the model on at most ``labelled`` rows of ``labels`` (0 or 1) and on all other documents.

    The labelled rows are those with the smallest hash of their id, so they are spread evenly and are the same on every
    run. An id with several labels has their majority, 1 on a tie; null ids and labels are left out. All other rows of
    ``docs`` take part without label, rows without id too; repeated rows count as often as they are there. Without
    labels every document scores one; with one kind of label only, or fewer than eight, it scores the share of good
    labels.

    A step of a round is one pass over stored features (1.1 KB a document). Its sums have a fixed size, and are added up
    in two levels.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    chosen = chosen.groupBy(F.col(f"`{id_col}`").alias("key")).agg((F.avg(F.col(f"`{label_col}`")) >= 0.5).cast("int").alias("label"))
    known = chosen.orderBy(F.xxhash64("key"), "key").limit(labelled)
    rows = pack(docs, doc=id_col, text=text_col, source=source_col, lang=lang_col, chars=chars_col)
    # at most ``labelled`` rows of two numbers, so they may be sent to every task
    rows = rows.join(F.broadcast(known), F.col("doc") == F.col("key"), "left").select("doc", "label", "text", "source", "lang", "chars")
    kind = rows.schema["doc"].dataType.simpleString()
    features = materialize(arrow_map(rows, _features, f"doc {kind}, label int, text array<float>, meta array<float>"), "features")
    got = features.where("label is not null").orderBy(F.xxhash64("doc"), "doc", "text").limit(labelled).toArrow()  # bounded likewise
    if not got.num_rows:
        return QualityModel()
    dense = lambda name: np.array(got.column(name).combine_chunks().flatten(), np.float64).reshape(got.num_rows, -1)
    others = features.where("label is null").select("text", "meta")

    def pool(teachers: list[np.ndarray], weights: list[np.ndarray]) -> dict[tuple[int, int], Sums]:
        return _pool_sums(spark, others, teachers, weights, sure)

    return co_train(dense("text"), dense("meta"), got.column("label").to_numpy(), pool, rounds, steps, ridge, trust)


SUMS = "view int, value int, salt int, n double, slope array<double>, curve array<double>"


def _sum_rows(sums: dict[tuple[int, int], Sums], salt: int) -> pa.RecordBatch:
    rows = [(i, value, salt, s.rows, s.slope, s.curve.ravel()) for (i, value), s in sums.items()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in SUMS.split(", ")])


def _pool_sums(spark, others: DataFrame, teachers: list[np.ndarray], weights: list[np.ndarray], sure: float) -> dict[tuple[int, int], Sums]:
    """``pseudo_sums`` over all rows of a table of features."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], Sums] = {}
        for batch in source:
            if not batch.num_rows:
                continue
            views = [batch.column(i).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1) for i in range(2)]
            for key, own in pseudo_sums(views, teachers, weights, sure).items():
                seen = total.get(key)
                total[key] = own if seen is None else Sums(seen.rows + own.rows, seen.slope + own.slope, seen.curve + own.curve)
        if total:
            yield _sum_rows(total, TaskContext.get().partitionId() % 32)

    def add(keys: tuple[pa.Scalar, ...], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in source:
            for i in range(batch.num_rows):
                own = [batch.column("n")[i].as_py(), *(batch.column(c)[i].values.to_numpy() for c in ("slope", "curve"))]
                total = own if total is None else [a + b for a, b in zip(total, own)]
        salt = keys[2].as_py() if len(keys) > 2 else 0
        columns = [pa.array([v], pa.int32()) for v in (keys[0].as_py(), keys[1].as_py(), salt)] + [pa.array([total[0]], pa.float64())]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in total[1:]]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SUMS.split(", ")])

    add.__annotations__ = {"keys": tuple[pa.Scalar, ...], "source": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    sums = others.mapInArrow(work, SUMS)
    for by in (["view", "value", "salt"], ["view", "value"]):
        sums = sums.groupBy(*by).applyInArrow(add, SUMS)
    found = {(i, value): Sums(0.0, np.zeros(len(weights[i])), np.zeros((len(weights[i]),) * 2)) for i in range(2) for value in (0, 1)}
    for r in sums.collect():  # four rows
        found[r["view"], r["value"]] = Sums(r["n"], np.array(r["slope"]), np.array(r["curve"]).reshape(len(r["slope"]), -1))
    return found


def _score(model: QualityModel, at: list[int], names: list[str], threshold: float, filtering: bool, batch: pa.RecordBatch) -> pa.RecordBatch:
    text, meta, both = model.scores(*_views([batch.column(i) for i in at]))
    accepted = pa.array(both >= threshold)
    if filtering:
        return batch.filter(accepted)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(text), pa.array(meta), pa.array(both), accepted], names)


def score(
    docs: DataFrame,
    model: QualityModel,
    threshold: float = 0.5,
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    chars_col: str = "n_chars",
    filtering: bool = False,
) -> DataFrame:
    """``docs`` with ``text_score, meta_score, score, accepted``; or only the accepted rows, columns as they were.

    A narrow pass. Null and empty texts have empty features and get a score like others; columns named like a result
    are replaced; an empty table gives an empty result.
    """
    added = {"text_score": "double", "meta_score": "double", "score": "double", "accepted": "boolean"}
    if not filtering:
        docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    schema = StructType(list(docs.schema.fields))
    at = [docs.columns.index(c) for c in (text_col, source_col, lang_col, chars_col)]
    if not filtering:
        for name, kind in added.items():
            schema = schema.add(name, kind)
    return arrow_map(docs, partial(_score, model, at, schema.names, threshold, filtering), schema)
