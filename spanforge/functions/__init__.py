"""Column expressions and row-wise Python for the operators."""
