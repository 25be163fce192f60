"""Incremental runs of the batch operators over a landing folder."""
