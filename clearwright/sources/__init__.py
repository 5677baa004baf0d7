"""Readers and document flatteners."""
