"""Forecasting jobs: fits are Spark aggregations, ML estimators or bounded group jobs."""
