"""Analytics of cyclic motion and wire-like graphs on Spark DataFrames."""
