"""Column builders: pure expressions over built-in functions."""
