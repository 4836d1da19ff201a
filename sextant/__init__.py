"""Batch text retrieval and ranking evaluation on Spark: every operator takes and returns DataFrames."""
