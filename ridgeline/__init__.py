"""Elastic-net regularization paths as Spark jobs."""

from ridgeline.plans.estimators import (  # noqa: F401
    ElasticNetPathClassificationModel,
    ElasticNetPathClassifier,
    ElasticNetPathRegressionModel,
    ElasticNetPathRegressor,
)
from ridgeline.plans.lazy import lazy_path  # noqa: F401
from ridgeline.plans.linear import elastic_net_path  # noqa: F401
from ridgeline.plans.logistic import logistic_path, sparse_logistic_path  # noqa: F401
from ridgeline.plans.selection import cross_validate, cross_validate_logistic  # noqa: F401
from ridgeline.plans.sparse import sparse_path  # noqa: F401
from ridgeline.session import get_session, shared_folder, ship_package  # noqa: F401
