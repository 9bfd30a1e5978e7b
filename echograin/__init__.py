"""Laser-scanning analytics on Spark DataFrames."""
