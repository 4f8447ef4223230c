"""Structured Streaming into stored tables."""
