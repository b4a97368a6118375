"""Relational operators over materials, observations, offers and issues."""
