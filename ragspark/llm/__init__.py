"""Operators of a training-data pipeline over the documents and embeddings tables."""
