"""Relational operators of the timeline engine."""
