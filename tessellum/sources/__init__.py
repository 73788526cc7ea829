"""Readers and table access."""
