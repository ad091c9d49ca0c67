"""Metric families as functions from DataFrames to DataFrames.  Columns are parameters, so any table can play a part."""
