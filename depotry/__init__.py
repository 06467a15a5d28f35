"""Facility-location analytics on Spark: where depots go, how many, and which serves each point."""
