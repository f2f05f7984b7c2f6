"""Column functions: text, numbers, vectors, presentation."""
