"""Tidewire: news and entity analytics on Spark DataFrames."""
