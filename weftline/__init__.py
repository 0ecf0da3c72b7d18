"""Workflows of typed steps as lazy DataFrames: Catalyst, AQE and Spark's scheduler do the optimising."""
