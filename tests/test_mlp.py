"""The perceptron's gradient, its stopping, and that partitions do not matter."""

import numpy as np
import pytest

from cohortlab.models import mlp
from cohortlab.models.catalogue import make_model

SIZES = (3, 5, 4, 1)


def loss(flat, x, y):
    margin = mlp.forward(mlp.unpacked(flat, SIZES), x)[-1][:, 0]
    return (np.logaddexp(0, margin) - y * margin).sum()


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(4)
    x, y, flat = draw.normal(size=(40, 3)), draw.integers(0, 2, 40).astype(float), mlp.first_weights(SIZES, 1)
    got = mlp.gradient(mlp.unpacked(flat, SIZES), x, y)
    assert got[:2] == pytest.approx([40, loss(flat, x, y)])
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert got[3 + i] == pytest.approx((loss(flat + step, x, y) - loss(flat - step, x, y)) / 2e-6, abs=1e-4)
    assert (mlp.penalty(flat, SIZES) != 0).sum() == 3 * 5 + 5 * 4 + 4


@pytest.fixture(scope="module")
def rings(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(900, 2))
    return spark.createDataFrame([(i, float(a), float(b), int(a * a + b * b > 1.4)) for i, (a, b) in enumerate(x)], "id long, a double, b double, y int")


def test_learns_what_is_not_linear_and_stops_early(spark, rings):
    model = make_model("mlp", {"max_iter": 60, "learning_rate_init": 0.02, "n_iter_no_change": 8})
    fitted = model.fit(rings, ["a", "b"], "y", "id")
    right = fitted.score(rings).filter("prediction = y").count()
    assert right > 0.93 * 900
    assert fitted.epochs <= 60 and fitted.best_epoch == int(np.argmax(fitted.held_accuracy)) + 1
    if fitted.epochs < 60:
        assert max(fitted.held_accuracy[-8:]) <= max(fitted.held_accuracy[:-8]) + mlp.RISE
    again = model.fit(rings.repartition(5), ["a", "b"], "y", "id")
    assert again.epochs == fitted.epochs and again.weights == pytest.approx(fitted.weights, abs=1e-6)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 1), (3, 0.1, 0), (4, 0.9, 1), (5, None, None), (6, 0.5, 2)], "id long, x double, y int")
    fitted = make_model("mlp", {"max_iter": 2, "hidden_layer_sizes": (3,)}).fit(rows, ["x"], "y", "id")  # too few rows to hold any back
    assert fitted.epochs == 2
    with pytest.raises(ValueError, match="one class"):
        make_model("mlp").fit(rows.filter("y = 1"), ["x"], "y", "id")
    with pytest.raises(Exception, match="missing or infinite"):
        make_model("mlp", {"max_iter": 1}).fit(spark.createDataFrame([(1, None, 0), (2, 1.0, 1)], "id long, x double, y int"), ["x"], "y", "id")
