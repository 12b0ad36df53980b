"""Column functions: key encodings and prefix ranges."""
