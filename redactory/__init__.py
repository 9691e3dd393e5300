"""Sensitive-text and governed-knowledge analytics on Spark DataFrames."""
