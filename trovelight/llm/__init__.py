"""Training-data operators. Nothing outside this package imports it."""
