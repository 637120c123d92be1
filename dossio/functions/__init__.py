"""Column functions: text, geometry, casts."""
