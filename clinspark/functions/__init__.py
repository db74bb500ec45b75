"""Column expressions: time arithmetic, flags and encodings."""
