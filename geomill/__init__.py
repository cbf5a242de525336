"""Spatial, volumetric and feature-vector analytics as Spark DataFrame jobs."""
