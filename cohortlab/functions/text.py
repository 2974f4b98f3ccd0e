"""Report text expressions: numbers, feature lists, parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/A"
# Parameters that lead a parameter text, in this order.
LEADING_PARAMS = ("n_estimators", "max_depth", "learning_rate", "subsample")


def metric_text(value: Column) -> Column:
    """Four decimals; ``format_string`` would spell NULL as a word, so test first."""
    return F.when(_missing(value), MISSING).otherwise(F.format_string("%.4f", value))


def delta_text(value: Column) -> Column:
    return F.when(_missing(value), MISSING).otherwise(F.format_string("%+.4f", value))


def names_text(names: Column) -> Column:
    """Comma list of an ordered name array, ``N/A`` when there is none."""
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.concat_ws(", ", names)).otherwise(MISSING)


def params_text(params: Column) -> Column:
    """``key=value`` list of a string map, the leading keys first."""
    lead = F.array(*[F.lit(k) for k in LEADING_PARAMS])
    head = F.filter(lead, lambda k: F.map_contains_key(params, k))
    tail = F.array_except(F.map_keys(params), lead)
    pairs = F.transform(F.concat(head, tail), lambda k: F.concat_ws("=", k, params[k]))
    return names_text(pairs)


def _missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)
