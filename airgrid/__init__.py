"""Airgrid: broadcast-schedule analytics on Spark DataFrames."""
