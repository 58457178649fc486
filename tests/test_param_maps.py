from __future__ import annotations

from ridgeline import ElasticNetPathRegressor
from ridgeline.operators.grid import PathParamGridBuilder
from verification.oracles import all_oracles
from verification.queries import all_queries


def test_param_maps_have_the_index_innermost(spark):
    lr = ElasticNetPathRegressor()
    maps = PathParamGridBuilder().addGrid(lr.elasticNetParam, [0.2, 1.0]).addGrid(lr.tol, [0.1, 0.01]).build_with_index(lr.lambdaIndex, 5)
    points = [(m[lr.elasticNetParam], m[lr.tol], m[lr.lambdaIndex]) for m in maps]
    assert points == [(a, t, k) for a in (0.2, 1.0) for t in (0.1, 0.01) for k in range(5)]


def test_model_explains_its_params(sample):
    model = ElasticNetPathRegressor(elasticNetParam=0.5, numLambdas=6, lambdaIndex=5).fit(sample)
    explained = dict(line.split(": ", 1) for line in model.explainParams().splitlines())
    assert set(explained) == {p.name for p in model.params}
    assert model.getOrDefault(model.elasticNetParam) == 0.5 and "current: 0.5" in explained["elasticNetParam"]


def test_neither_is_a_query():
    assert not {"m14_param_grid", "m18_explain_params"} & (set(all_queries()) | set(all_oracles()))
