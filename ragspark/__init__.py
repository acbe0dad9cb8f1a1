"""Batch and streaming document retrieval and grounded question answering on Spark DataFrames."""
