"""Collections, their catalog, the planner and the query language."""
