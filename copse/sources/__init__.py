"""Readers and sample data."""
