"""Column expressions: distances and metadata filters."""
