"""Contracts, readers and writers."""
