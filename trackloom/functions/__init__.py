"""Column builders and window helpers."""
