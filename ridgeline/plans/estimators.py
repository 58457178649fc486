"""Spark ML estimators over the path operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model, _FitMultipleIterator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasElasticNetParam,
    HasFeaturesCol,
    HasFitIntercept,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
    HasTol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ridgeline.functions import logistic_probability
from ridgeline.operators.design import design
from ridgeline.operators.moments import moments
from ridgeline.operators.scoring import linear_score
from ridgeline.plans.descent import PathConfig
from ridgeline.plans.lazy import lazy_cells, spread_out
from ridgeline.plans.linear import solve_cells
from ridgeline.plans.logistic import LogisticConfig, logistic_cells
from ridgeline.session import scratch_scope


class _PathParams(
    HasFeaturesCol, HasLabelCol, HasPredictionCol, HasElasticNetParam, HasMaxIter, HasTol, HasFitIntercept
):
    lambdaIndex = Param(
        Params._dummy(), "lambdaIndex", "path point that a single fit returns (>= 0)", TypeConverters.toInt
    )
    numLambdas = Param(Params._dummy(), "numLambdas", "number of penalties on the path (> 0)", TypeConverters.toInt)
    lambdaShrink = Param(
        Params._dummy(), "lambdaShrink", "smallest over largest penalty of the path (> 0)", TypeConverters.toFloat
    )
    handleInvalid = Param(
        Params._dummy(),
        "handleInvalid",
        "what to do in a fit with rows that hold null, NaN or infinity: error or skip",
        TypeConverters.toString,
    )

    def getHandleInvalid(self) -> str:  # noqa: N802
        return self.getOrDefault(self.handleInvalid)

    def getLambdaIndex(self) -> int:  # noqa: N802 - Spark ML naming
        return self.getOrDefault(self.lambdaIndex)

    def getNumLambdas(self) -> int:  # noqa: N802
        return self.getOrDefault(self.numLambdas)

    def getLambdaShrink(self) -> float:  # noqa: N802
        return self.getOrDefault(self.lambdaShrink)


class _PathEstimator(Estimator, _PathParams, DefaultParamsReadable, DefaultParamsWritable):
    """Shared by both estimators: many parameter maps cost one path per distinct configuration."""

    def setParams(self, **values):  # noqa: N802
        return self._set(**values)

    def setElasticNetParam(self, value: float):  # noqa: N802
        return self._set(elasticNetParam=value)

    def setNumLambdas(self, value: int):  # noqa: N802
        return self._set(numLambdas=value)

    def setLambdaShrink(self, value: float):  # noqa: N802
        return self._set(lambdaShrink=value)

    def setLambdaIndex(self, value: int):  # noqa: N802
        return self._set(lambdaIndex=value)

    def setMaxIter(self, value: int):  # noqa: N802
        return self._set(maxIter=value)

    def setTol(self, value: float):  # noqa: N802
        return self._set(tol=value)

    def setFitIntercept(self, value: bool):  # noqa: N802
        return self._set(fitIntercept=value)

    def setFeaturesCol(self, value: str):  # noqa: N802
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):  # noqa: N802
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):  # noqa: N802
        return self._set(predictionCol=value)

    def setHandleInvalid(self, value: str):  # noqa: N802
        return self._set(handleInvalid=value)

    def _config(self):
        raise NotImplementedError

    def _paths(self, dataset: DataFrame, configs: list) -> DataFrame:
        raise NotImplementedError

    def _input(self) -> tuple:
        """What a scan depends on; stages that agree in it share one."""
        return self.getLabelCol(), self.getFeaturesCol(), self.getHandleInvalid()

    def _model(self, row) -> Model:
        raise NotImplementedError

    def _check_index(self) -> None:
        index, count = self.getLambdaIndex(), self.getNumLambdas()
        if not 0 <= index < count:
            raise ValueError(f"lambdaIndex {index} is outside a path of {count} penalties")

    def _fit(self, dataset: DataFrame) -> Model:
        return self._fit_all(dataset, [self])[0]

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]):  # noqa: N802, N803
        stages = [self.copy(m) for m in paramMaps]
        models = self._fit_all(dataset, stages)
        return _FitMultipleIterator(lambda i: models[i], len(models))

    def _fit_all(self, dataset: DataFrame, stages: list) -> list[Model]:
        with scratch_scope(dataset.sparkSession):  # models hold all that is needed
            return self._fit_stages(dataset, stages)

    def _fit_stages(self, dataset: DataFrame, stages: list) -> list[Model]:
        for stage in stages:
            stage._check_index()
        # one scan per distinct input, one path per distinct configuration on it
        inputs: dict[tuple, dict] = {}
        readers = {}
        places = []
        for stage in stages:
            key = stage._input()
            readers.setdefault(key, stage)
            configs = inputs.setdefault(key, {})
            cell = configs.setdefault(stage._config(), len(configs))
            places.append((key, cell, stage.getLambdaIndex()))
        rows = {}
        for key, configs in inputs.items():
            wanted = sorted({(cell, index) for k, cell, index in places if k == key})
            points = F.struct("cell", "lambda_idx").isin(
                [F.struct(F.lit(c).alias("cell"), F.lit(i).alias("lambda_idx")) for c, i in wanted]
            )
            path = readers[key]._paths(dataset, list(configs))
            for row in path.where(points).collect():  # one small row per requested model
                rows[key, row["cell"], row["lambda_idx"]] = row
        models = []
        for stage, place in zip(stages, places):
            model = stage._copyValues(stage._model(rows[place]))
            model.converged = bool(rows[place]["converged"])
            models.append(model)
        return models


class _PathModel(Model, _PathParams):
    def __init__(self, weights: Sequence[float] = (), intercept: float = 0.0, penalty: float | None = None):
        super().__init__()
        self.weights = DenseVector(np.asarray(weights, dtype=float))
        self.intercept = float(intercept)
        self.penalty = penalty
        self.converged: bool | None = None  # whether the solver met its tolerance at this point

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return len(self.weights)

    def order_of_weights(self) -> list[int]:
        """0-based feature positions by falling absolute weight, ties in feature order."""
        return np.argsort(-np.abs(self.weights.toArray()), kind="stable").tolist()

    def _score(self, dataset: DataFrame):
        return linear_score(dataset, self.getFeaturesCol(), self.weights.toArray(), self.intercept)

    def copy(self, extra: dict | None = None):
        that = super().copy(extra)
        that.weights, that.intercept, that.penalty = self.weights, self.intercept, self.penalty
        that.converged = self.converged
        return that


class ElasticNetPathRegressionModel(_PathModel):
    """A linear model picked from a path."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), self._score(dataset))


class ElasticNetPathRegressor(_PathEstimator):
    """Elastic-net linear regression that fits whole paths and returns one point of them.

    ``gramMode="lazy"`` is for wide input: it computes cross-products only for features about
    to enter the path.
    """

    gramMode = Param(
        Params._dummy(), "gramMode", "cross-products to compute: full or lazy", TypeConverters.toString
    )

    def setGramMode(self, value: str):  # noqa: N802
        return self._set(gramMode=value)

    def getGramMode(self) -> str:  # noqa: N802
        return self.getOrDefault(self.gramMode)

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",  # noqa: N803 - Spark ML naming
        labelCol="label",  # noqa: N803
        predictionCol="prediction",  # noqa: N803
        elasticNetParam=0.01,  # noqa: N803
        numLambdas=100,  # noqa: N803
        lambdaShrink=1e-3,  # noqa: N803
        lambdaIndex=99,  # noqa: N803
        maxIter=100,  # noqa: N803
        tol=1e-3,
        fitIntercept=True,  # noqa: N803
        gramMode="full",  # noqa: N803
        handleInvalid="error",  # noqa: N803
    ):
        super().__init__()
        self._setDefault(
            gramMode="full",
            handleInvalid="error",
            elasticNetParam=0.01,
            numLambdas=100,
            lambdaShrink=1e-3,
            lambdaIndex=99,
            maxIter=100,
            tol=1e-3,
            fitIntercept=True,
        )
        self._set(**self._input_kwargs)

    def _config(self) -> PathConfig:
        return PathConfig(
            alpha=self.getElasticNetParam(),
            num_lambdas=self.getNumLambdas(),
            lambda_shrink=self.getLambdaShrink(),
            tol=self.getTol(),
            max_iter=self.getMaxIter(),
            fit_intercept=self.getFitIntercept(),
        )

    def _input(self) -> tuple:
        return *super()._input(), self.getGramMode()

    def _paths(self, dataset: DataFrame, configs: list) -> DataFrame:
        frame = design(dataset, self.getLabelCol(), self.getFeaturesCol(), handle_invalid=self.getHandleInvalid())
        if self.getGramMode() not in ("full", "lazy"):
            raise ValueError("gramMode must be full or lazy")
        return lazy_cells(frame, configs) if self.getGramMode() == "lazy" else solve_cells(moments(frame), configs)

    def _model(self, row) -> ElasticNetPathRegressionModel:
        if "indices" in row:
            weights = spread_out(row["width"], row["indices"], row["weights"])
            return ElasticNetPathRegressionModel(weights, row["intercept"], row["lambda"])
        return ElasticNetPathRegressionModel(row["weights"], row["intercept"], row["lambda"])


class ElasticNetPathClassificationModel(_PathModel, HasRawPredictionCol, HasProbabilityCol):
    """A binary logistic model picked from a path."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = dataset.withColumn("_score", self._score(dataset))
        one = logistic_probability("_score")
        return scored.withColumns(
            {
                self.getRawPredictionCol(): array_to_vector(F.array(-F.col("_score"), F.col("_score"))),
                self.getProbabilityCol(): array_to_vector(F.array(1.0 - one, one)),
                self.getPredictionCol(): F.when(one > 0.5, 1.0).otherwise(0.0),
            }
        ).drop("_score")


class ElasticNetPathClassifier(_PathEstimator, HasRawPredictionCol, HasProbabilityCol):
    """Elastic-net logistic regression that fits whole paths and returns one point of them.

    Without ``lambdaShrink`` the penalty grid has its fixed step. ``maxRounds`` bounds the reweighting
    steps of each penalty; ``converged`` of a model tells whether they were enough. Labels are 0 or 1.
    """

    maxRounds = Param(
        Params._dummy(), "maxRounds", "largest number of reweighting steps per penalty (> 0)", TypeConverters.toInt
    )

    def getMaxRounds(self) -> int:  # noqa: N802
        return self.getOrDefault(self.maxRounds)

    def setMaxRounds(self, value: int):  # noqa: N802
        return self._set(maxRounds=value)

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",  # noqa: N803
        labelCol="label",  # noqa: N803
        predictionCol="prediction",  # noqa: N803
        rawPredictionCol="rawPrediction",  # noqa: N803
        probabilityCol="probability",  # noqa: N803
        elasticNetParam=1.0,  # noqa: N803
        numLambdas=100,  # noqa: N803
        lambdaShrink=None,  # noqa: N803
        lambdaIndex=99,  # noqa: N803
        maxIter=100,  # noqa: N803
        tol=0.01,
        fitIntercept=True,  # noqa: N803
        handleInvalid="error",  # noqa: N803
        maxRounds=25,  # noqa: N803
    ):
        super().__init__()
        self._setDefault(
            elasticNetParam=1.0,
            numLambdas=100,
            lambdaIndex=99,
            maxIter=100,
            tol=0.01,
            fitIntercept=True,
            handleInvalid="error",
            maxRounds=25,
        )
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _config(self) -> LogisticConfig:
        return LogisticConfig(
            alpha=self.getElasticNetParam(),
            num_lambdas=self.getNumLambdas(),
            lambda_shrink=self.getLambdaShrink() if self.isDefined(self.lambdaShrink) else None,
            tol=self.getTol(),
            inner_tol=self.getTol(),
            max_iter=self.getMaxIter(),
            max_rounds=self.getMaxRounds(),
            fit_intercept=self.getFitIntercept(),
        )

    def _paths(self, dataset: DataFrame, configs: list) -> DataFrame:
        label, features = self.getLabelCol(), self.getFeaturesCol()
        return logistic_cells(dataset, label, features, configs, handle_invalid=self.getHandleInvalid(), mode="auto")

    def _model(self, row) -> ElasticNetPathClassificationModel:
        return ElasticNetPathClassificationModel(row["weights"], row["intercept"], row["lambda"])
