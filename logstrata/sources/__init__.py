"""Stores on a file system: databases, logs and catalogs."""
