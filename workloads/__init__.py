"""Queries on the given tables, each with the SQL it is checked against."""

from workloads import attribution, cleaning, folds, joins, metrics, models, recursions, reports, runs, selection, stores, windows  # noqa: F401
from workloads.registry import QUERIES, SQL  # noqa: F401
