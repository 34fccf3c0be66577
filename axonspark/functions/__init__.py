"""Column expressions: labels, numbers, text predicates."""
