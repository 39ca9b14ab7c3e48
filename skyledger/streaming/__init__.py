"""Structured Streaming jobs; every sink can replay a batch without harm."""
