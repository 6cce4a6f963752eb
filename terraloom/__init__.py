"""Spatial analytics as Spark DataFrames."""
