"""Batch lakehouse jobs on Spark: CSV -> bronze -> silver -> gold star schema -> SQL."""
