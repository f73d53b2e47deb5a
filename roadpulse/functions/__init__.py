"""Column expressions: geometry and fuzzy inference."""
