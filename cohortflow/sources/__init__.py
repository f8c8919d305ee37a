"""Readers of curated and landed files, file catalog rules, and sinks."""
