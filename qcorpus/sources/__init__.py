"""Readers and parsers that turn landed artifacts into rows."""
