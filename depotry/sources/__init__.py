"""Readers, writers, validation and built-in data."""
