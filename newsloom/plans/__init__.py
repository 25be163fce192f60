"""Composed plans, checkpoint staging, and the catalogue of registered queries."""
