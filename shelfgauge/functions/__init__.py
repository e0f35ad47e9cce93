"""Column expressions for package sizes and texts."""
