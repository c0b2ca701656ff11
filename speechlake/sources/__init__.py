"""Readers and writers for the file formats of a corpus."""
