"""Voxel-volume analytics on Spark: volumes, blocks, surfaces and images as DataFrames."""
