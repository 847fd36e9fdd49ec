"""Volumetric analytics on PySpark DataFrames."""
