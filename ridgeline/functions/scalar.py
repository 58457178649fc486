"""Column expressions shared by the operators. All of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The margin floor and the probability guard of the iteratively weighted fit.
MARGIN_FLOOR = -100.0
PROBABILITY_GUARD = 1e-5


def _column(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def soft_threshold(z: Column | str, gamma: Column | str | float) -> Column:
    """``sign(z) * max(|z| - gamma, 0)``; adding 0.0 keeps a negative zero out of the result."""
    z, gamma = _column(z), _column(gamma)
    return F.signum(z) * F.greatest(F.abs(z) - gamma, F.lit(0.0)) + F.lit(0.0)


def logistic_probability(margin: Column | str) -> Column:
    """Probability of class 1 for a linear score, with the score floored."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(_column(margin), F.lit(MARGIN_FLOOR))))


def clamped_probability(probability: Column | str) -> Column:
    """Probabilities within the guard of 0 or 1 become exactly 0 or 1."""
    p = _column(probability)
    return (
        F.when(F.abs(p) < PROBABILITY_GUARD, F.lit(0.0))
        .when(F.abs(F.lit(1.0) - p) < PROBABILITY_GUARD, F.lit(1.0))
        .otherwise(p)
    )


def working_weight(probability: Column | str) -> Column:
    """Row weight ``p (1 - p)``, held at the guard value where the probability is clamped."""
    p = _column(probability)
    clamped = (F.abs(p) < PROBABILITY_GUARD) | (F.abs(F.lit(1.0) - p) < PROBABILITY_GUARD)
    return F.when(clamped, F.lit(PROBABILITY_GUARD)).otherwise(p * (F.lit(1.0) - p))


def working_response(label: Column | str, probability: Column | str, margin: Column | str) -> Column:
    """Adjusted response ``(y - p) / w + margin`` of one reweighting step."""
    p = _column(probability)
    return (_column(label) - clamped_probability(p)) / working_weight(p) + _column(margin)


def standardize(value: Column | str, mean: Column | str | float, std: Column | str | float) -> Column:
    """``(value - mean) / std``; a constant column becomes 0."""
    std = _column(std)
    return F.when(std == 0.0, F.lit(0.0)).otherwise((_column(value) - _column(mean)) / std)


def recode(value: Column | str, positive: str) -> Column:
    """1.0 where the text equals the positive code, else 0.0; null stays null."""
    return (_column(value) == positive).cast("double")


def slice_array(features: Column | str, indexes: Sequence[int]) -> Column:
    """Pick entries of an array column by 0-based position, in the order given."""
    features = _column(features)
    return F.array(*[F.element_at(features, int(i) + 1) for i in indexes])


def _balanced_sum(terms: list[Column]) -> Column:
    while len(terms) > 1:
        pairs = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = pairs + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def dot(features: Column | str | Sequence, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Linear score. ``features`` is one array column or a list of numeric columns.

    A null array or a null entry gives null, NaN gives NaN even under a zero weight, and an array of
    another length than ``weights`` fails.
    """
    if isinstance(features, (Column, str)):
        array = _column(features)
        terms = [F.get(array, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights)]
        return checked_width(array, len(weights), _balanced_sum(terms + [F.lit(float(intercept))]))
    if len(features) != len(weights):
        raise ValueError(f"{len(features)} features but {len(weights)} weights")
    terms = [_column(f) * F.lit(float(w)) for f, w in zip(features, weights)]
    return _balanced_sum(terms + [F.lit(float(intercept))])


def checked_width(array: Column, width: int, value: Column) -> Column:
    """``value`` where the array has the width, null where it is null, else an error."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {width} features but got "), F.size(array).cast("string")))
    return F.when(array.isNull(), F.lit(None)).when(F.size(array) == width, value).otherwise(wrong)
