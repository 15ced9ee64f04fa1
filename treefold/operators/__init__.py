"""DataFrame operators over record tables."""
