"""Ordinal-addressed, fixed-schema record sets on Spark DataFrames."""
