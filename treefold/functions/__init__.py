"""Column functions: paths and content hashes."""
