"""Operators over DataFrames of queries, documents, hits and relevance labels."""
