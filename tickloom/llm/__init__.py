"""Operators over corpora of texts. Nothing outside this package imports it."""
