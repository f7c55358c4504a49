"""Exact time-bucketed analytics on PySpark DataFrames."""
