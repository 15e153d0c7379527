"""Machine-learning operations analytics as Spark table and stream jobs."""

__version__ = "0.1.0"
