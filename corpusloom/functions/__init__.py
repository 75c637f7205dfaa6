"""Column functions: text, vectors, labels."""
