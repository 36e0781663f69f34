"""Azerbaijani text analytics on Spark DataFrames."""
