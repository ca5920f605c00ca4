"""Column expressions and scalar tail probabilities."""
