"""The eleven classifiers with their parameters, by key."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortlab.models import mllib
from cohortlab.models.adaboost import AdaBoost
from cohortlab.models.base import Model
from cohortlab.models.boosting import BoostedTrees, by_leaf, by_level, symmetric
from cohortlab.models.forest import RandomForest
from cohortlab.models.gaussian_nb import GaussianNB
from cohortlab.models.kernel_svm import KernelSVM
from cohortlab.models.knn import KNN
from cohortlab.models.logistic import LogisticRegression
from cohortlab.models.mllib import MllibModel
from cohortlab.models.mlp import MLP


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Mapping, int], Model]
    defaults: Mapping
    grid: Mapping[str, Sequence]
    fidelity: str  # exact, equivalent or approximate
    iterations: int = 8


def _boosted(shape):
    return lambda params, seed: BoostedTrees(shape, params, seed)


def _mllib(build):
    return lambda params, seed: MllibModel(build, params, seed)


#: Levels up to which a forest grows in passes over all rows; below them nodes are many and small, and MLlib counts more of them in a pass.
DEEPEST_FOREST = 8


def _forest(params: Mapping, seed: int) -> Model:
    depth = params["max_depth"]
    return RandomForest(params, seed) if depth is not None and 0 < depth <= DEEPEST_FOREST else MllibModel(mllib.random_forest, params, seed)


# Names, default parameters and search grids. Left out are thread
# counts, verbosity and solver names, and what MLlib has no counterpart for:
# min_samples_split.
CATALOGUE: dict[str, Entry] = {
    "logistic_regression": Entry(
        "Logistic Regression", LogisticRegression,
        {"C": 1.0, "max_iter": 2000},
        {"C": [0.01, 0.1, 1.0, 5.0, 10.0]},
        "exact",
    ),
    "random_forest": Entry(
        "Random Forest", _forest,
        {"n_estimators": 250, "max_depth": 6, "min_samples_leaf": 1},
        {"n_estimators": [150, 250, 400], "max_depth": [4, 6, 8, None], "min_samples_leaf": [1, 2, 4]},
        "equivalent",
    ),
    "xgboost": Entry(
        "XGBoost", _boosted(by_level),
        {"n_estimators": 120, "max_depth": 4, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0},
        {
            "n_estimators": [80, 120, 180, 240], "max_depth": [3, 4, 5, 6], "learning_rate": [0.03, 0.05, 0.1, 0.2],
            "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0],
        },
        "equivalent",
    ),
    "lightgbm": Entry(
        "LightGBM", _boosted(by_leaf),
        {
            "n_estimators": 200, "learning_rate": 0.05, "num_leaves": 31, "max_depth": -1, "min_child_samples": 20,
            "subsample": 1.0, "colsample_bytree": 1.0,
        },
        {
            "n_estimators": [120, 200, 300], "learning_rate": [0.03, 0.05, 0.1], "num_leaves": [15, 31, 63],
            "max_depth": [-1, 4, 6, 8], "min_child_samples": [10, 20, 30], "subsample": [0.8, 1.0],
            "colsample_bytree": [0.8, 1.0],
        },
        "equivalent",
    ),
    "svm": Entry(
        "Support Vector Machine (SVM)", KernelSVM,
        {"C": 1.0, "kernel": "rbf", "gamma": "scale"},
        {"C": [0.1, 1.0, 10.0, 25.0], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]},
        "approximate",
    ),
    "mlp": Entry(
        "Artificial Neural Network (MLP)", MLP,
        {"hidden_layer_sizes": (64, 32), "alpha": 1e-4, "learning_rate_init": 1e-3, "max_iter": 1200, "early_stopping": True, "n_iter_no_change": 30},
        {
            "hidden_layer_sizes": [(32,), (64,), (64, 32), (128, 64)], "alpha": [1e-5, 1e-4, 1e-3, 1e-2],
            "learning_rate_init": [1e-4, 5e-4, 1e-3, 1e-2],
        },
        "equivalent",
    ),
    "knn": Entry(
        "K-Nearest Neighbors (KNN)", KNN,
        {"n_neighbors": 7, "weights": "distance", "p": 2},
        {"n_neighbors": [3, 5, 7, 9, 11, 15], "weights": ["uniform", "distance"], "p": [1, 2]},
        "exact",
    ),
    "decision_tree": Entry(
        "Decision Tree", _mllib(mllib.decision_tree),
        {"max_depth": 5, "min_samples_leaf": 1},
        {"criterion": ["gini", "entropy"], "max_depth": [3, 5, 7, None], "min_samples_leaf": [1, 2, 4]},
        "equivalent",
    ),
    "naive_bayes": Entry(
        "Naive Bayes", lambda params, seed: GaussianNB(params),
        {"var_smoothing": 1e-9},
        {"var_smoothing": [1e-11, 1e-10, 1e-9, 1e-8, 1e-7]},
        "exact", iterations=5,
    ),
    "catboost": Entry(
        "CatBoost", _boosted(symmetric),
        {"iterations": 200, "depth": 6, "learning_rate": 0.05, "l2_leaf_reg": 3.0},
        {
            "iterations": [120, 200, 320], "depth": [4, 6, 8], "learning_rate": [0.03, 0.05, 0.1],
            "l2_leaf_reg": [1.0, 3.0, 5.0, 7.0],
        },
        "approximate",
    ),
    "adaboost": Entry(
        "AdaBoost", lambda params, seed: AdaBoost(params),
        {"n_estimators": 150, "learning_rate": 0.5},
        {"n_estimators": [50, 100, 150, 250], "learning_rate": [0.01, 0.05, 0.1, 0.5, 1.0]},
        "equivalent",
    ),
}


def entry(key: str) -> Entry:
    if key not in CATALOGUE:
        raise KeyError(f"unknown model {key!r}; known: {', '.join(CATALOGUE)}")
    return CATALOGUE[key]


def make_model(key: str, params: Mapping | None = None, seed: int = 42) -> Model:
    """A model with ``params`` laid over its defaults."""
    known = entry(key)
    strange = set(params or {}) - set(known.defaults) - set(known.grid)
    if strange:
        raise TypeError(f"{key} has no parameter {', '.join(sorted(strange))}")
    return known.build({**known.defaults, **(params or {})}, seed)


def grid_points(key: str, seed: int = 42, iterations: int | None = None) -> list[dict]:
    """Distinct random points of the search grid."""
    known = entry(key)
    points = [dict(zip(known.grid, values)) for values in itertools.product(*known.grid.values())]
    wanted = min(len(points), known.iterations if iterations is None else iterations)
    return random.Random(seed).sample(points, wanted)


def models_catalogue(spark: SparkSession) -> DataFrame:
    text = lambda values: {k: str(v) for k, v in values.items()}
    rows = [
        (i, key, e.name, text(e.defaults), text(e.grid), e.iterations, e.fidelity, True)
        for i, (key, e) in enumerate(CATALOGUE.items())
    ]
    schema = (
        "position int, model_key string, model_name string, defaults map<string,string>,"
        " grid map<string,string>, search_iterations int, fidelity string, available boolean"
    )
    return spark.createDataFrame(rows, schema)
