"""Column-expression and window helpers shared by the operators."""
