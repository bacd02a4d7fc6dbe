"""Readers and writers for raw and normalized data."""
