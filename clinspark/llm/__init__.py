"""Operators of a training-data pipeline over documents and web pages; nothing else in the library imports them."""
