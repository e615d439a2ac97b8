"""Column-expression functions (no Python UDFs)."""
