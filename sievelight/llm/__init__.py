"""Operators on training text: scoring, language, archives, duplicates, contamination, quality, mixing, search."""
