"""Operators of a training-data pipeline over documents, pages and embeddings."""
