"""Lodestone: data-mining analytics on Spark DataFrames."""
