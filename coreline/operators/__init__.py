"""Generic operators on DataFrames."""
