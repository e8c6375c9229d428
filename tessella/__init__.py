"""Tile, morphology and vector analytics as Spark jobs."""
