"""Nearest-neighbour data work on Spark DataFrames."""
