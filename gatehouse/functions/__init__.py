"""Column expressions: policies, vectors, text."""
