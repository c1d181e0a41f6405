"""Column functions: pattern text, normalised strings, similarities."""
