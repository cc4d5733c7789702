"""Column expressions: time, measures, scoring."""
