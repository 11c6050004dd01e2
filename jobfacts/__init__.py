"""Batch-cluster job analytics on Spark DataFrames."""
