"""Patterns over streams of triples."""
