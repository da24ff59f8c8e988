"""Package of the engine: see README.md."""
