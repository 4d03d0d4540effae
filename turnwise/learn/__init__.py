"""Grouped cross validation, ablations and bulk scoring with Spark ML."""
