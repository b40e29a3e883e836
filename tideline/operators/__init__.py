"""Operators: features, labels, joins, folds, metrics, model jobs, reports."""
