"""Trajectory tables: schema, adapters, and the readers of the driver's tables."""
