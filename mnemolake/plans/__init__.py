"""Composite jobs built from operators."""
