"""Readers that turn files and addresses into DataFrames."""
