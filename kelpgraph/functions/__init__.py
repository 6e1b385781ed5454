"""Column expressions for text, paths, vectors and counters."""
