"""Readers of landed files and the normalisers that turn them into articles."""
