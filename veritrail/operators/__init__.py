"""Operators on feeds and graph: DataFrames in, DataFrames out."""
