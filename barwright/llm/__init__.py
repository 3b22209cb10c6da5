"""Corpus operators for training-data pipelines, built on Spark DataFrames."""
