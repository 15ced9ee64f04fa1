"""Whole commands built from the operators."""
