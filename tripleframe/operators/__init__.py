"""Inference, hierarchies, validation and extraction over triples."""
