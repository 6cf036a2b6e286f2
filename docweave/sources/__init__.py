"""Readers, converters and storage."""
