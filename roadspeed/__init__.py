"""Spark jobs for short-term road-speed forecasting."""
