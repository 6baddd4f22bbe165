"""Column expressions and small scalar statistics shared by the operators."""
