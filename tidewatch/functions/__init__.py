"""Column expressions and special functions shared by the operators."""
