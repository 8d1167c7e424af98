"""Data side of generative recommendation with semantic item ids, on Spark DataFrames."""
