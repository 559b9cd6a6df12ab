"""Flood-mapping analytics on Spark: grids, objects and catalogs as DataFrames."""
