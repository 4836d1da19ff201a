"""Column functions: text and vectors."""
