"""Column-expression helpers (scalar functions F1-F25)."""
