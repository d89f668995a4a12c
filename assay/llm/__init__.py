"""Operators for building large training-text corpora with Spark.

Every operator is a function from DataFrames to a DataFrame; nothing outside
this subpackage imports it.
"""
