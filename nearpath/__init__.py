"""Trajectory similarity search and corpus processing on Spark DataFrames."""
