"""Trajectory analytics on Spark: DataFrame-first operators, sources, plans and streams."""

__version__ = "0.1.0"
