"""Spark-native numerical analytics: linear systems, numerics and result-set analysis as DataFrames."""
