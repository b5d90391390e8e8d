"""Relational operators over segment tables."""
