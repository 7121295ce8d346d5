"""Volumetric image preparation, compression and evaluation as Spark jobs."""
