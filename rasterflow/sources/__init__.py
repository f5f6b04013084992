"""Readers and writers of media files."""
