"""Structured Streaming forms of append-style operators."""
