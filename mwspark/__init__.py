"""Adaptive multiwavelet functions as Spark tables."""
