"""Query operators: each maps DataFrames to a DataFrame and runs no job of its own."""
