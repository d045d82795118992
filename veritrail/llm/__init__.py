"""Operators of a training-data pipeline: ten independent modules and their queries.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; what it stores between passes lives in the folder that
``spark.checkpoint.dir`` names (see ``shared``).
"""
