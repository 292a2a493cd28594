"""Relational operators over typed records."""
