"""Operators over the star schema: DataFrames in, a DataFrame out."""
