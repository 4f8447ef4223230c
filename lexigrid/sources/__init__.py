"""Readers and writers for the stored tables."""
