"""Temporal dependency-graph analytics on PySpark DataFrames."""
