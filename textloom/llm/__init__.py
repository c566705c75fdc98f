"""Operators for building training corpora; see ``queries.py`` for the registry."""
