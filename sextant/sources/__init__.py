"""Readers, the vector store, and encoders."""
