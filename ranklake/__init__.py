"""ranklake: rank-coded vector and text retrieval as PySpark DataFrame plans."""
