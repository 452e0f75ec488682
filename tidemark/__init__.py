"""Tidemark: point-in-time series analytics and probabilistic forecasting as Spark plans."""
