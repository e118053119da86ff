"""Operators for large-scale text data; nothing else in the library imports them."""
