"""Stored sets: a manifest, an operation log, and a dictionary as Parquet."""
