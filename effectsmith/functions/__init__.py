"""Column expressions and small helpers shared by operators."""
