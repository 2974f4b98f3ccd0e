"""The checks of fitted models say no to wrong ones."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cohortlab.models import histograms
from cohortlab.models.catalogue import make_model
from registry.queries import _checks


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.createDataFrame([(i, float(i % 40), float(i * 7 % 11), int(i % 40 + i * 7 % 11 > 30)) for i in range(800)], "row_id long, a double, b double, label int")
    return table.cache()


def model(prediction, probability, **more):
    return SimpleNamespace(score=lambda df: df.withColumn("prediction", F.expr(prediction)).withColumn("probability", F.expr(probability)), **more)


def test_logistic_regression_must_rank(rows):
    right = make_model("logistic_regression").fit(rows, ["a", "b"], "label", "row_id")
    assert _checks("logistic_regression", right, rows) == ("logistic_regression", True, True, True, None)
    assert _checks("logistic_regression", model("0", "0.3"), rows)[2] is False
    assert _checks("logistic_regression", model("0", "0.5 - a / 200"), rows)[2] is False


def test_predictions_of_the_svm_follow_its_plane(rows):
    right = make_model("svm").fit(rows, ["a", "b"], "label", "row_id")
    assert _checks("svm", right, rows) == ("svm", True, True, True, None)
    assert _checks("svm", model("1 - label", "0.2 + 0.6 * label", intercept=0.0), rows)[3] is False
    assert _checks("svm", model("0", "0.2 + 0.6 * label", intercept=0.0), rows)[3] is False


def test_adaboost_must_bring_its_own_loss_down(rows):
    right = make_model("adaboost", {"n_estimators": 20}).fit(rows, ["a", "b"], "label", "row_id")
    assert _checks("adaboost", right, rows)[1] is True
    assert _checks("adaboost", model("0", "0.4", stumps=right.stumps), rows)[1] is False  # no more errors than the class shares have


def test_adaboost_of_few_rows_is_that_of_passes(rows, monkeypatch):
    fit = lambda: make_model("adaboost", {"n_estimators": 20}).fit(rows, ["a", "b"], "label", "row_id").stumps
    few = fit()
    monkeypatch.setattr(histograms, "ALONE_ROWS", 0)
    for one, two in zip(few, fit(), strict=True):
        assert (one.feature, one.last_bin, one.low, one.high) == (two.feature, two.last_bin, two.low, two.high)
        assert one.alpha == pytest.approx(two.alpha)
