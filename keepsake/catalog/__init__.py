"""Registered queries over the driver tables (Spark side and SQL oracle)."""
