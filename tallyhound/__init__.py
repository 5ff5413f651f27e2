"""Prospect-signal analytics on Spark DataFrames."""
