"""Spark-native land-records analytics: every operation is a function from DataFrames and parameters to a DataFrame."""
