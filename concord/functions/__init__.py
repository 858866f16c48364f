"""Column expressions. Everything here stays inside Spark's own functions."""
