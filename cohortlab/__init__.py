"""Cohort-aware binary classification on Spark DataFrames."""

from cohortlab.spec import CLINICAL, TableSpec

__all__ = ["CLINICAL", "TableSpec"]
