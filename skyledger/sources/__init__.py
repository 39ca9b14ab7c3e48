"""Readers, writers and payload parsing."""
