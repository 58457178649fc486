"""Elastic-net paths of sparse rows: products of nonzeros only, no array as long as the number of features.

One pass adds up the products of columns that share a row, the label's among them. The rounds are those of the wide
path: active features are solved for in a task of each path, and all others are checked by a join of the pair sums with
the few coefficients of the points. What two columns without a common row have in common follows from their means.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F

from ridgeline.operators.sparse import SUM_SCHEMA, pair_sums, sparse_rows, sparse_scales
from ridgeline.plans.descent import PathConfig, lambda_grid
from ridgeline.plans.journal import Journal
from ridgeline.plans.lazy import ACTIVE_SCHEMA, FIRST_WINDOW, LOOK_AHEAD, Progress, Training, _Fit
from ridgeline.session import ship_package

FEATURE_SCHEMA = "feature int, mean double, std double, xy double, raw_xy double"
STRONGEST = 1024  # features that a point may ask for at once; more come in the next rounds


def sparse_path(
    df: DataFrame,
    label: Column | str,
    features: str,
    alphas: Sequence[float] = (0.01,),
    *,
    journal: str | None = None,
    **options,
) -> DataFrame:
    """Paths with sparse weights from a vector column, or a struct column with ``indices`` and ``values``.

    The same models as ``lazy_path``. A row costs the square of its nonzeros. Nulls, NaN and infinities fail, in the
    label too, and so does an index that a row has twice; an input without rows fails. The width is that of the first
    vector, or one more than the largest index of a struct column.
    """
    ship_package(df.sparkSession)
    configs = [PathConfig(alpha=float(a), **options) for a in alphas]
    if any(c.entry != "full" for c in configs):
        raise ValueError("the sparse path always checks every feature before it keeps a point")
    fit = _SparseFit(df, label, features, configs, Journal(df.sparkSession, journal, "sparse-path"))
    while fit.open:
        fit.one_round()
    return fit.points()


class _SparseFit(_Fit):
    """The rounds of the wide path over pair sums in place of dense products."""

    def __init__(self, df: DataFrame, label: Column | str, features: str, configs: Sequence[PathConfig], journal: Journal):
        self.spark, self.journal, self.cached = df.sparkSession, journal, []
        self.cells = [(-1, i, config) for i, config in enumerate(configs)]
        target = (F.col(label) if isinstance(label, str) else label).cast("double")
        rows = sparse_rows(df.withColumn("_label", target), features, None, "_label")
        if isinstance(df.schema[features].dataType, VectorUDT):
            first = df.select(F.unwrap_udt(features).alias("v")).select(F.coalesce("v.size", F.size("v.values")).alias("width")).first()
        else:
            first = rows.agg(F.coalesce(F.max(F.array_max("indices")) + 1, F.lit(0)).alias("width")).first()
        self.width = 0 if first is None else first["width"]
        # the label is one more column
        rows = rows.select("fold", F.concat("indices", F.array(F.lit(self.width))).alias("indices"), F.concat("values", F.array("_label")).alias("values"))
        self.sums = journal.table("pair-sums", lambda: pair_sums(rows), SUM_SCHEMA)
        scales = journal.table("scales", lambda: sparse_scales(rows, self.sums)).drop("fold")
        own = scales.where(F.col("feature") == self.width).first()
        n = own["n"] if own else float(rows.count())
        if n == 0:
            raise ValueError("no rows to train on")
        label_mean, label_std = (own["mean"], own["std"]) if own else (0.0, 0.0)
        self.training = {-1: Training(n, label_mean, label_std, {})}
        self.features_table = journal.table("features", lambda: self._features(scales, n, label_mean, label_std), FEATURE_SCHEMA)
        tops = self.features_table.agg(F.max(F.abs("xy")).alias("top"), F.max(F.abs("raw_xy")).alias("raw")).first()
        self.training[-1].top = {True: tops["top"] or 0.0, False: tops["raw"] or 0.0}
        self.lambdas = [None if label_std == 0.0 else lambda_grid(self.training[-1].top[c.fit_intercept], c) for c in configs]
        self.progress = [Progress() for _ in configs]
        self.parts, self.kept, self.round, self.window = [], [], 0, FIRST_WINDOW
        self.settings = [asdict(c) for c in configs] + [self.width, "sparse"]
        self._resume()

    def _features(self, scales: DataFrame, n: float, label_mean: float, label_std: float) -> DataFrame:
        """Scale of every column that is not all zero, and its product with the label."""
        with_label = self.sums.where((F.col("j") == self.width) & (F.col("i") >= 0) & (F.col("i") < self.width)).select(F.col("i").alias("feature"), "s")
        both = scales.where(F.col("feature") < self.width).join(with_label, "feature", "left")
        raw = F.coalesce("s", F.lit(0.0)) / F.lit(n)
        scale = F.lit(label_std) * F.col("std")
        usable = scale > 0

        def scaled(value: Column) -> Column:
            return F.when(usable, value / scale).otherwise(F.lit(0.0))

        return both.select("feature", "mean", "std", scaled(raw - F.col("mean") * F.lit(label_mean)).alias("xy"), scaled(raw).alias("raw_xy"))

    def _learn(self, features: Sequence[int]) -> None:
        own = self.spark.createDataFrame([(f,) for f in features], "feature int")
        for r in self.features_table.join(own, "feature").collect():
            self.training[-1].scales[r["feature"]] = (r["mean"], r["std"], r["xy"], r["raw_xy"])

    def _grow(self, fresh: list[int]) -> None:
        """The products of new features with active ones; a row for each new feature."""
        self._learn(fresh)
        self.parts.append(fresh)
        known, n = sorted(self.features), self.training[-1].n
        mean = {f: self.training[-1].scales[f][0] for f in known}

        def products() -> DataFrame:
            part = self.spark.createDataFrame([(f, mean[f]) for f in fresh], "a int, mean_a double")
            slots = self.spark.createDataFrame([(f, mean[f]) for f in known], "b int, mean_b double")
            # every new feature with every active one: the size of the block that a path solves
            pairs = part.withColumn("b", F.explode(F.array(*map(F.lit, known)))).join(slots, "b")
            pairs = pairs.where((F.col("b") >= F.col("a")) | ~F.col("b").isin(fresh))  # two new ones meet once
            sums = self.sums.where("i >= 0").select("i", "j", "s")
            pairs = pairs.join(sums, (F.col("i") == F.least("a", "b")) & (F.col("j") == F.greatest("a", "b")), "left")
            centred = F.coalesce("s", F.lit(0.0)) - F.lit(n) * F.col("mean_a") * F.col("mean_b")
            rows = pairs.groupBy("a", "mean_a").agg(F.array_sort(F.collect_list(F.struct((F.col("b") + 1).alias("slot"), F.col("mean_b").alias("mean"), centred.alias("c")))).alias("e"))
            return rows.select(
                F.lit(0).alias("fold"), F.lit(n).alias("n"), F.array("a").alias("anchors"), F.col("e.slot").alias("slots"),
                F.array("mean_a").alias("anchor_mean"), F.col("e.mean").alias("mean"), F.col("e.c").alias("c"),
            )

        self.journal.table(self._name("active", len(self.parts)), products, ACTIVE_SCHEMA)

    def _check(self, features: list[int], solved: list) -> tuple[dict[int, int], set[int]]:
        points = [r for r in solved if r["lambda"] is not None]
        if not points:
            return {}, set()
        n, scales = self.training[-1].n, self.training[-1].scales
        slopes = [(i, f, b / scales[f][1]) for i, r in enumerate(points) for f, b in zip(r["indices"], r["beta"])]
        centred = [self.cells[r["number"]][2].fit_intercept for r in points]
        alpha = [self.cells[r["number"]][2].alpha for r in points]
        shift = [0.0] * len(points)  # what all columns have in common with a point through their means
        for i, f, v in slopes:
            shift[i] += scales[f][0] * v if centred[i] else 0.0
        bound = [r["lambda"] * a for r, a in zip(points, alpha)]
        ahead = [float(self.lambdas[r["number"]][min(r["lambda_idx"] + LOOK_AHEAD, len(self.lambdas[r["number"]]) - 1)]) * a for r, a in zip(points, alpha)]
        pairs = self.sums.where((F.col("i") >= 0) & (F.col("j") < self.width))
        both = pairs.select(F.col("i").alias("a"), F.col("j").alias("feature"), "s").unionByName(
            pairs.where("i < j").select(F.col("j").alias("a"), F.col("i").alias("feature"), "s")
        )
        fitted = both.join(self.spark.createDataFrame(slopes, "point int, a int, v double"), "a")
        fitted = fitted.groupBy("point", "feature").agg(F.sum(F.col("s") * F.col("v")).alias("fitted"))

        def of(values: list) -> Column:
            return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("point") + 1)

        active = self.spark.createDataFrame([(f,) for f in features], "feature int")
        every = self.features_table.where("std > 0").join(active, "feature", "left_anti")
        every = every.withColumn("point", F.explode(F.array(*map(F.lit, range(len(points))))))
        every = every.join(fitted, ["point", "feature"], "left")
        total = F.coalesce("fitted", F.lit(0.0)) / F.lit(n) - F.col("mean") * of(shift)
        xy = F.when(of(centred), F.col("xy")).otherwise(F.col("raw_xy"))
        found = every.select("point", "feature", F.abs(xy - total / F.col("std")).alias("slope"))
        # of each point the features with the largest slopes, picked in every task first
        best = Window.partitionBy("point").orderBy(F.col("slope").desc(), "feature")
        found = found.where(F.col("slope") > of(ahead)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= STRONGEST)
        by_point: dict[int, list] = {}
        for r in found.collect():
            by_point.setdefault(r["point"], []).append(r)
        violated: dict[int, int] = {}
        wanted: set[int] = set()
        for i, point in enumerate(points):
            own = by_point.get(i, [])
            if point["number"] not in violated and any(r["slope"] > bound[i] for r in own):
                violated[point["number"]] = point["lambda_idx"]
                wanted |= {r["feature"] for r in own}
        return violated, wanted
