"""Operators for preparing text and embedding corpora; nothing else in the library imports this."""
