"""Structured Streaming form of record scoring."""
