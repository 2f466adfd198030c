"""Relational operators of the integration engine."""
