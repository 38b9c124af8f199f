"""Quern: structure and similarity analytics for text corpora, on Spark DataFrames."""
