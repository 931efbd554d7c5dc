"""Tabular error detection on Spark."""
