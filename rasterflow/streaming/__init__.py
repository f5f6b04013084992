"""Structured Streaming over media events."""
