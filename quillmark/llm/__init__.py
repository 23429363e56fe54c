"""Operators of a training-data pipeline: ten operators over documents, pages and embeddings.

Nothing else in the package imports this subpackage.
"""
