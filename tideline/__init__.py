"""tideline: risk analytics on price series, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
