"""Behavioural profiling of turn-based event sequences on Spark DataFrames."""

__version__ = "0.1.0"
