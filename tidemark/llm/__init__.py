"""Operators for large text corpora: duplicates, quality, language, leaks, secrets, tokens.

Nothing else in the library imports this package; the entry module adds its queries when it is here.
"""
