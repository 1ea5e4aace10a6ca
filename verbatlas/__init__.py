"""verbatlas: a Spark-first engine for usage-based corpus analytics."""

__version__ = "0.1.0"
