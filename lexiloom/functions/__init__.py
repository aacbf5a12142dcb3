"""Column functions: text, hashing and numeric expressions."""
