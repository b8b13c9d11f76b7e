"""Raster screening and evidence analytics on Spark DataFrames."""
