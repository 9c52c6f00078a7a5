"""Spark-native analytics for long-read transcript ends.

Every operator is a function from DataFrames to a DataFrame; nothing here runs a
job unless its docstring says so.
"""

__version__ = "0.1.0"
