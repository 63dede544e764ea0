"""CSV files and layer tables."""
