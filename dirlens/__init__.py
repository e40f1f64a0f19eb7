"""Profiling and comparison of healthcare directory deliveries on Spark."""

__version__ = "0.1.0"
