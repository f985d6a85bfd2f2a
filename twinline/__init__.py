"""Twinline: prepare and score parallel text corpora with Spark DataFrames."""
