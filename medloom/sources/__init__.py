"""Readers, writers and the lookup of input files."""
