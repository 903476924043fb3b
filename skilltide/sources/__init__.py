"""Readers and row parsers."""
