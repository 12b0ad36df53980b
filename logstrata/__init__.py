"""Versioned key-value analytics over an append-only mutation log, on Spark."""
