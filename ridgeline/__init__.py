"""Terrain field analytics on Spark."""
