"""Published results of known data sets."""

from __future__ import annotations

import os

import numpy as np
import pytest

from ridgeline import elastic_net_path, logistic_path
from ridgeline.functions import recode
from ridgeline.operators.design import design
from ridgeline.operators.gram import cross_products, label_products
from ridgeline.operators.moments import moments
from ridgeline.operators.screening import entry_order, nonzero_features
from ridgeline.operators.profile import array_profile, label_profile
from ridgeline.sources.text import read_labeled_text

# fixed values: expected results for the 501-row sample at alpha 0.2
XY = """0.005944563470736933 0.03313933240474521 -0.04058341841726883 0.12293184432367361 0.023963866956494304
0.06473219499435058 -0.0223547983117894 -0.02792547542246454 -0.035917023071009774 0.03445179158794948"""
FIRST_LAMBDA, LAST_LAMBDA = 0.5736333620998728, 6.146592216183661e-4
WEIGHTS = {
    0: "0 0 0 0.10609407237852213 0 0 0 0 0 0",
    19: """0 0.13940962181519762 -0.17225901337109625 1.5628567289876516 0 0.5662482120242629 0
    -0.010351711124052835 -0.06487146660728328 0.06249892116161966""",
    49: """0 0.7317756614864737 -0.7191993265805297 2.3174601898727305 0.43235421873691404 1.0728927172695415
    -0.23539174248895098 -0.44652927311465557 -0.5457386525684538 0.6056776968528177""",
    99: """0.005474969281157915 0.828251626256302 -0.8065807982804625 2.437251437602151 0.516396531369916
    1.1508241348214323 -0.2970080994754068 -0.5107022555555861 -0.6172727621766044 0.6928032515194796""",
}
# fixed values: the order in which the 60 sonar features enter the logistic path
SONAR_ORDER = """10 48 44 11 35 51 20 3 21 43 50 15 22 27 0 30 53 58 56 6 28 36 39 47 19 7 49 54 2 8 29 38 23 57
13 32 31 42 59 37 45 52 16 25 46 18 33 1 55 4 17 26 12 5 40 34 24 41 9 14"""
SONAR_FILE = os.environ.get("RIDGELINE_SONAR_FILE", "")


def numbers(text: str) -> np.ndarray:
    return np.array([float(v) for v in text.split()])


def test_label_products(sample):
    xy = label_products(cross_products(moments(design(sample, "label", "features")))).orderBy("feature").collect()
    assert np.allclose([r["xy"] for r in xy], numbers(XY), rtol=0, atol=1e-14)


@pytest.mark.parametrize("entry, tolerance", [("lagged", 1e-12), ("full", 1e-3)])
def test_linear_path(sample, entry, tolerance):
    path = elastic_net_path(sample, "label", "features", [0.2], entry=entry).orderBy("lambda_idx").collect()
    assert len(path) == 100
    assert path[0]["lambda"] == pytest.approx(FIRST_LAMBDA, rel=1e-12)
    assert path[99]["lambda"] == pytest.approx(LAST_LAMBDA, rel=1e-12)
    for index, expected in WEIGHTS.items():
        assert np.abs(np.array(path[index]["weights"]) - numbers(expected)).max() <= tolerance


def test_features_enter_in_the_logged_steps(sample):
    path = elastic_net_path(sample, "label", "features", [0.2], entry="lagged")
    order = entry_order(nonzero_features(path)).orderBy("position").collect()
    # the log counts penalties from 1
    assert [r["first_idx"] + 1 for r in order] == [1, 10, 16, 17, 19, 19, 20, 23, 27, 81]


@pytest.mark.skipif(not os.path.exists(SONAR_FILE), reason="set RIDGELINE_SONAR_FILE to the public sonar CSV")
def test_sonar(spark):
    rows = read_labeled_text(spark, SONAR_FILE, convert_label=lambda c: recode(c, "M"))
    label = label_profile(rows, "label").first()
    assert (label["n"], label["mean"], label["std"]) == (208, pytest.approx(111 / 208), pytest.approx(0.500069671846))
    first = array_profile(rows, "features").where("feature = 0").first()
    assert first["mean"] == pytest.approx(0.029163942307692307, abs=1e-13)
    assert first["std"] == pytest.approx(0.022990913933847074, abs=1e-13)
    path = logistic_path(rows, "label", "features", [1.0], freeze_intercept=True, carry_step=False)
    order = entry_order(nonzero_features(path)).orderBy("position").collect()
    assert [r["feature"] for r in order] == [int(v) for v in SONAR_ORDER.split()]
    points = path.orderBy("lambda_idx").collect()
    assert all(abs(p["beta0"]) < 1e-12 for p in points)
    assert all(p["converged"] for p in points)
