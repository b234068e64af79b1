"""Readers, split handling and writers."""
