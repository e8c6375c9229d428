"""Operators on DataFrames: grids, rasters, blending, nuclei, vectors, tasks."""
