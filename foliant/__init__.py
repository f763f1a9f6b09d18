"""Foliant: document analytics on Spark DataFrames."""
