"""Structured Streaming over a growing record log."""
