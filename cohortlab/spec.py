"""Column roles of a cohort classification table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

OVERALL = "overall"
UNKNOWN = "Unknown"


@dataclass(frozen=True)
class TableSpec:
    """Which column plays which role.

    ``categorical`` maps a column to its fixed category list; the first
    category of each list gets no dummy. ``sentinel`` names a column value
    that marks a row as unusable.
    """

    row_id: str
    label: str
    numeric: tuple[str, ...]
    cohort_by: str
    cutoffs: tuple[float, float]
    categorical: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    binary: tuple[str, ...] = ()
    cohorts: tuple[str, str, str] = ("Young", "Middle", "Elderly")
    cohort: str = "age_group"
    sentinel: tuple[str, int] | None = None

    @property
    def dummy_groups(self) -> dict[str, list[str]]:
        return {c: [f"{c}_{k}" for k in ks[1:]] for c, ks in self.categorical.items()}

    @property
    def dummies(self) -> list[str]:
        return [name for names in self.dummy_groups.values() for name in names]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.dummies, *self.binary]

    @property
    def rules(self) -> dict[str, str]:
        """The cohort borders in words."""
        (low, high), by = self.cutoffs, self.cohort_by
        young, middle, old = self.cohorts
        return {young: f"{by} < {low:g}", middle: f"{low:g} <= {by} <= {high:g}", old: f"{by} > {high:g}"}

    @property
    def raw_columns(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.binary, self.label]


# The clinical table every default refers to.
CLINICAL = TableSpec(
    row_id="row_id",
    label="target",
    numeric=("age", "resting_bp_s", "cholesterol", "max_heart_rate", "oldpeak"),
    categorical={
        "chest_pain_type": (1, 2, 3, 4),
        "resting_ecg": (0, 1, 2),
        "st_slope": (1, 2, 3),
    },
    binary=("sex", "fasting_blood_sugar", "exercise_angina"),
    cohort_by="age",
    cutoffs=(45.0, 65.0),
    sentinel=("st_slope", 0),
)
