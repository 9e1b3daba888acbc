"""Vegetation time series of satellite scenes as Spark DataFrames."""
