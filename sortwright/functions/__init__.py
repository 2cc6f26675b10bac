"""Column expressions: vectors, text, names and file signatures."""
