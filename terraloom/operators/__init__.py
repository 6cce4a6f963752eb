"""Operators on DataFrames: statistics, grids, points, networks, matrices, flows, urban dynamics."""
