"""Reading, normalising and writing measurement tables."""
